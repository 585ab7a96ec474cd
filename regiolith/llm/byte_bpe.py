"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding.  Within one match of the splitting pattern the merges are compiled
into a finite-state transducer over bytes.  A state is (the token emitted last,
the bytes read since).  It knows the last token of the encoding of each prefix
of those bytes: BPE by ranks has the property that a sequence of tokens is an
encoding if each token and each neighbouring pair encodes to itself, so the
encodings of all prefixes form a tree.  A prefix is live while the bytes after
it still start some longer token; tokens that all live prefixes agree on are
emitted at once.  The lookahead is thus bounded by the longest token, and a
match of any length takes time in proportion to its bytes.  States and arcs are
made when first needed and kept up to ``MAX_STATES``; results of whole matches
are kept up to ``MAX_MATCHES``.  When full, either table starts anew.

Decoding.  Ids become bytes; an incremental UTF-8 state machine (``Utf8``)
accepts them in pieces cut anywhere and says where characters end.

Rows: a null text counts as empty and has no tokens; the digests are then those
of the empty string.  Rows stand for themselves, so repeats, ties, null ids and
other columns have no influence.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regiolith.llm.common import lean, prepare

MAX_STATES = 900_000
MAX_MATCHES = 600_000

_SPACE = r"\t\n\v\f\r \x85\xa0"
_LETTER = r"A-Za-z\xaa\xb5\xbaÀ-ÖØ-öø-ÿĀ-ɏ"
_DIGIT = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: A text with other characters than these is split by the regex library.
_ODD = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞]")
#: public_tokenizers.PATTERN for texts without odd characters, its classes written out.
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Utf8:
    """An incremental UTF-8 decoder.  State 0: between characters; -1: not UTF-8; else what may follow.

    A state is (continuation bytes left, lowest and highest next byte) packed in an int.
    """

    def __init__(self) -> None:
        self.state, self._rest = 0, b""

    @staticmethod
    def step(state: int, byte: int) -> int:
        if state < 0:
            return -1
        if state:
            left, low, high = state >> 16, state >> 8 & 255, state & 255
            if not low <= byte <= high:
                return -1
            return (left - 1) << 16 | 0x80BF if left > 1 else 0
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1 << 16 | 0x80BF
        if 0xE0 <= byte <= 0xEF:
            return 2 << 16 | {0xE0: 0xA0BF, 0xED: 0x809F}.get(byte, 0x80BF)
        if 0xF0 <= byte <= 0xF4:
            return 3 << 16 | {0xF0: 0x90BF, 0xF4: 0x808F}.get(byte, 0x80BF)
        return -1

    def run(self, state: int, data: bytes) -> int:
        for b in data:
            state = self.step(state, b)
        return state

    def feed(self, data: bytes) -> str:
        """The characters that end within data; an unfinished one waits for more.  Bytes that are not UTF-8 raise ValueError."""
        done, state = 0, self.state
        held = self._rest + data
        for i, b in enumerate(data, len(self._rest)):
            state = self.step(state, b)
            if state < 0:
                raise ValueError(f"byte {b:#x} can't stand here")
            if not state:
                done = i + 1
        self.state, self._rest = state, held[done:]
        return held[:done].decode()


class BytePairs:
    """The encoder and decoder of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_matches: int = MAX_MATCHES) -> None:
        self.ranks, self.pattern, self.max_states, self.max_matches = ranks, pattern, max_states, max_matches
        self.token = {i: t for t, i in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._sides: dict[int, tuple[list[int], list[int]]] = {}
        self._child: dict[int, int] = {}
        self._ends, self._more = [-1], [True]
        for t, rank in ranks.items():
            node = 0
            for b in t:
                self._more[node] = True
                below = self._child.setdefault(node << 8 | b, len(self._ends))
                if below == len(self._ends):
                    self._ends.append(-1)
                    self._more.append(False)
                node = below
            self._ends[node] = rank
        self._length = {i: len(t) for i, t in self.token.items()}
        self._decimal = {i: b"%d" % i for i in self.token}
        top = max(ranks.values()) + 1
        self._vocabulary = [self.token.get(i, b"") for i in range(top)]
        utf8 = Utf8()
        self._after = np.array([utf8.run(0, t) for t in self._vocabulary], np.int64)
        self._kind, self._code = (np.uint16, "H") if top <= 1 << 16 else (np.uint32, "I")
        self._regex = None
        self._matches: dict[str, tuple[bytes, bytes]] = {}
        self._reset()

    @classmethod
    def load(cls, path: str, pattern: str, *limits: int) -> BytePairs:
        with open(path, "rb") as f:
            return cls.of(f.read(), pattern, *limits)

    @classmethod
    def of(cls, data: bytes, pattern: str, *limits: int) -> BytePairs:
        """From what a rank file holds."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern, *limits)

    # ------------------------------------------------------------ the transducer

    def _reset(self) -> None:
        self._names: dict[bytes, int] = {}
        self._state: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = []
        self._arcs: dict[int, int] = {}  # the next state, or the complement of a place in _emits
        self._emits: list[tuple[int, tuple[int, ...]]] = []
        self._intern(-1, b"", (), ())

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by repeated merging of the pair of lowest rank, of ranks under below; only for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list[int], list[int]]:
        """What stands at the token's right and left edge while it is merged, from bytes to the token itself."""
        if token not in self._sides:
            halves = self.merge(self.token[token], below=token) if len(self.token[token]) > 1 else []
            left, right = ([], []) if len(halves) != 2 else (self._edges(halves[0])[1], self._edges(halves[1])[0])
            self._sides[token] = ([*right, token], [*left, token])
        return self._sides[token]

    def _stands(self, before: int, token: int) -> bool:
        """Whether token can follow before in an encoding (-1: nothing comes before).

        Replays the merges next to their common edge in order of rank: the pair
        stands unless, at some time, the two neighbours there merge before either
        is taken up by its own side.  Of equal ranks the left one goes first.
        """
        if before < 0:
            if token not in self._own:
                self._own[token] = self.merge(self.token[token]) == [token]
            return self._own[token]
        stands = self._pairs.get(before << 32 | token)
        if stands is None:
            left, right, i, j, stands = self._edges(before)[0], self._edges(token)[1], 0, 0, True
            while True:
                up = left[i + 1] if i + 1 < len(left) else 1 << 60
                down = right[j + 1] if j + 1 < len(right) else 1 << 60
                both = self.ranks.get(self.token[left[i]] + self.token[right[j]], 1 << 60)
                if both < up and both <= down and both < 1 << 60:
                    stands = False
                    break
                if up == down == 1 << 60:
                    break
                if up <= down:
                    i += 1
                else:
                    j += 1
            self._pairs[before << 32 | token] = stands
        return stands

    def _intern(self, before: int, data: bytes, last: tuple[int, ...], live: tuple[int, ...]) -> int:
        """The state of these bytes; last: the last token of each prefix; live: where each unfinished token starts, and its node."""
        key = (before + 1).to_bytes(4, "little") + data
        name = self._names.get(key)
        if name is None:
            name = self._names[key] = len(self._state)
            self._state.append((key, last, live))
        return name

    def _path(self, last: tuple[int, ...], end: int) -> list[int]:
        out = []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= self._length[token]
        return out[::-1]

    def _arc(self, state: int, byte: int) -> int:
        key, last, live = self._state[state]
        before, data = int.from_bytes(key[:4], "little") - 1, key[4:]
        n, on, token, length = len(data), [], -1, self._length
        pairs = iter((*live, n, 0))
        for at, node in zip(pairs, pairs):
            below = self._child.get(node << 8 | byte)
            if below is not None:
                if self._more[below]:
                    on += at, below
                if token < 0 <= (t := self._ends[below]) and self._stands(-1, t) and self._stands(last[at - 1] if at else before, t):
                    token = t
        data, last = data + bytes((byte,)), (*last, token)
        meet = {*on[::2], n + 1}
        while len(meet) > 1:  # to the last prefix that all of them go through
            i = max(meet)
            meet.remove(i)
            meet.add(i - length[last[i - 1]])
        (cut,) = meet
        key = state << 8 | byte
        if not cut:
            self._arcs[key] = arc = self._intern(before, data, last, tuple(on))
            return arc
        out = tuple(self._path(last, cut))
        on[::2] = [at - cut for at in on[::2]]
        self._emits.append((self._intern(out[-1], data[cut:], last[cut:], tuple(on)), out))
        self._arcs[key] = arc = -len(self._emits)
        return arc

    def transduce(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern, in one pass from left to right."""
        if len(self._state) > self.max_states:
            self._reset()
            self._pairs.clear()
        arcs, emits, state, ids = self._arcs, self._emits, 0, []
        for b in data:
            state = arcs.get(state << 8 | b) or self._arc(state, b)  # no arc leads back to state 0
            if state < 0:
                state, out = emits[~state]
                ids += out
        last = self._state[state][1]
        ids += self._path(last, len(last))
        return ids

    # ------------------------------------------------------------ whole texts

    def split(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return _PLAIN.findall(text)
        if self._regex is None:
            import regex

            # \s of the tokenizer's library leaves out the separators 1C-1F
            self._regex = regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        return self._regex.findall(text)

    def _look(self, match: str) -> tuple[bytes, bytes]:
        ids = self.transduce(match.encode())
        if len(self._matches) >= self.max_matches:
            self._matches.clear()
        found = self._matches[match] = (b" ".join(map(self._decimal.__getitem__, ids)), array(self._code, ids).tobytes())
        return found

    def encode_both(self, text: str) -> tuple[bytes, np.ndarray]:
        """The decimal ids joined by spaces, and the ids."""
        if not text:
            return b"", np.zeros(0, self._kind)
        get, look = self._matches.get, self._look
        decimals, ids = zip(*[get(m) or look(m) for m in self.split(text)])
        return b" ".join(decimals), np.frombuffer(b"".join(ids), self._kind)

    def encode(self, text: str) -> list[int]:
        return self.encode_both(text)[1].tolist()

    def decode_bytes(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes of ids, and whether they are whole UTF-8; the state machine only runs where a token isn't whole by itself."""
        vocabulary = self._vocabulary
        data = b"".join(map(vocabulary.__getitem__, ids.tolist()))
        odd, step, at, state = np.flatnonzero(self._after[ids]).tolist(), Utf8().run, 0, 0
        for i in odd:
            if i < at:
                continue
            at, state = i, 0
            while at < len(ids):
                state = step(state, vocabulary[ids[at]])
                at += 1
                if state <= 0:
                    break
            if state < 0:
                break
        return data, state == 0

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Streaming: the text that each id completes."""
        machine = Utf8()
        for i in ids:
            yield machine.feed(self._vocabulary[i])


_loaded: dict[tuple, BytePairs] = {}


def held(data: bytes, pattern: str, *limits: int) -> BytePairs:
    """The tokenizer of what a rank file holds, kept for later tasks of the same worker."""
    key = (hashlib.sha256(data).digest(), pattern, *limits)
    if key not in _loaded:
        _loaded[key] = BytePairs.of(data, pattern, *limits)
        gc.freeze()
    return _loaded[key]


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def prepared(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, limits: tuple[int, int] = (MAX_STATES, MAX_MATCHES), keep: bool = True) -> DataFrame:
    """Encodes every text and decodes its ids again.

    docs: doc_id, text.  Returns a row per input row: doc_id, n_tokens,
    ids_sha256, decoded_sha256, whole (the decoded bytes are whole UTF-8), and
    ids array<int> if asked for.  limits: states and whole matches that a worker
    keeps, of about 1 KB together; fewer take more time.  keep: workers hold on to
    them for later tasks.
    """
    path, pattern = path or defaults()[0], pattern or defaults()[1]
    with open(path, "rb") as f:  # read here, as workers may not have the file
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "whole": "boolean"} | ({"ids": "array<int>"} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(ranks.value, pattern, *limits)
        gc.disable()  # the tables hold no cycles, and walking them takes long
        for b in batches:
            n, first, second, whole, kept = [], [], [], [], []
            for text in b["text"]:
                decimals, ids = bpe.encode_both(text.as_py() or "")
                data, good = bpe.decode_bytes(ids)
                n.append(len(ids))
                first.append(hashlib.sha256(decimals).hexdigest())
                second.append(hashlib.sha256(data).hexdigest())
                whole.append(good)
                if with_ids:
                    kept.append(ids)
            cols = [b["doc_id"], pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(whole, pa.bool_())]
            if with_ids:
                values = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays(cols, list(kinds))
        if keep:
            gc.freeze()
        else:
            bpe = None
            _loaded.clear()
        gc.enable()

    return prepared(docs).mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in kinds.items()))
