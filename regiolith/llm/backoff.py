"""Language-model scoring by a weighted backoff automaton.

The model's tokens are lower-cased words and one end per document, learned from
the documents whose crc32(doc_id) mod 5 is not 1.  Every n-gram of one, two and
three of their tokens is kept, whatever its count.  Probabilities are smoothed by
hierarchical Dirichlet priors, P(w | h) = (c(hw) + K * P(w | h')) / (c(h) + K),
where h' is h without its first token, down to one share for each known word and
one for all unknown words.  They sum to one over these, in any state.

As an automaton: a state for each context seen (none, a word, two words); an arc
for each n-gram, with the logarithm of its smoothed probability; from each state
a failure arc to the state of h', with log K / (c(h) + K).  A token without an arc
takes the failure arc and tries again there.  The state after a token is that of
the longest context seen, so it depends on two tokens at most, and one pass
carries the states of all places of a text along as arrays.

There are too many states to hold or to broadcast.  Texts are dealt to chunks of
about CHUNK_BYTES.  Each chunk names the n-grams that it holds, once each, with
how often its training texts hold them; ranges of n-grams meet in tasks that add
up the counts and answer each chunk with those that other chunks hold as well.
Words and pairs come first; of the n-grams of three a chunk then names those of
which both pairs were answered, as no other chunk can hold the rest.  With its
own counts and the answers a chunk has all arcs that its texts can take, and
traverses them.  A chunk and a range are both bounded; a frequent n-gram is named
once by a chunk.

N-grams are told apart by 58-bit hashes: of 10^13, one in 30,000 shares its counts
with another.  Rows: null and empty texts are one end.
A null doc_id is not held out and is learned from.  Rows that repeat both doc_id
and text count as often as they stand in the table, and each gets its result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import LOWER, U64, cut, flat, lean, mix, prepare, slices, tidy, word_hashes, word_spans

#: The weight K of the prior of words, of words after one, and of words after two.
PRIORS = (1.0, 40.0, 15.0)
#: Bytes of text whose n-grams a chunk names, and whose share of all n-grams a range holds.
CHUNK_BYTES = 12 << 20
#: Bytes of text that a task gathers before it deals them to chunks.
HELD_BYTES = 32 << 20
BEGIN, END = U64(0x9AE16A3B2F90404F), U64(0xC3A5C85C97CB3127)  # stand for the hashes of words
#: Low bits of a key without hash: what is left tells 2^58 n-grams apart, and packs into less.
SPARE = U64(6)
_TIMES = U64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the one-, two- and three-gram that end at each token (rows; 0: none), and the n + 1 offsets of the documents in tokens."""
    keys, at = [], [np.zeros(1, np.int64)]
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        s, e, words = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        own = words + np.arange(len(words))  # with an end after each document
        token = np.full(own[-1], END)
        token[np.arange(len(s)) + np.repeat(np.arange(len(words) - 1), np.diff(words))] = word_hashes(part, s, e)
        before = np.roll(token, 1)
        before[own[:-1]] = BEGIN
        two = mix(mix(before * _TIMES) + token)
        three = mix(np.roll(two, 1) * _TIMES + token)
        grams = np.stack([mix(token + _TIMES), two, three])
        grams = grams >> SPARE << SPARE | np.array([[1], [2], [3]], np.uint64)  # an order's keys are its own
        grams[2, own[:-1]] = 0
        keys.append(grams)
        at.append(own[1:] + at[-1][-1])
    return np.concatenate(keys, axis=1) if keys else np.zeros((3, 0), np.uint64), np.concatenate(at)


def planes(x: np.ndarray, wide: int) -> bytes:
    """The low bytes of numbers, all first ones before all second ones, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, blob): a partition's rows (chunk, doc_id, held_out, text), those of a chunk packed together."""
    held: list[pa.RecordBatch] = []

    def send() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("chunk")
        held.clear()
        chunk = table["chunk"].to_numpy()
        new = np.flatnonzero(np.diff(chunk, prepend=-1))
        out = []
        for i, j in zip(new.tolist(), np.append(new[1:], len(chunk)).tolist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.slice(i, j - i).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[new], pa.int64()), pa.array(out, pa.binary())], ["chunk", "blob"])

    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) > HELD_BYTES:
            yield send()
    if sum(len(x) for x in held):
        yield send()


def rows_of(group: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group["blob"]])


def numbers(data: bytes, n: int, wide: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, n * wide).reshape(wide, n).T
    return out.view("<u8").ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest takes, compressed."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return len(x).to_bytes(8, "little") + bytes([wide]) + pa.compress(planes(x, wide), "zstd", asbytes=True)


def unpack_counts(blob: bytes) -> np.ndarray:
    n, wide = int.from_bytes(blob[:8], "little"), blob[8]
    return numbers(pa.decompress(blob[9:], n * wide, "zstd", asbytes=True), n, wide).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys, by their differences."""
    return keys[:1].astype("<u8").tobytes() + pack_counts(np.diff(keys))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(blob, "<u8", 1), unpack_counts(blob[8:]).view(np.uint64)), dtype=np.uint64)


def learned(held: pa.Array, at: np.ndarray) -> np.ndarray:
    """Which tokens are of training texts."""
    return np.repeat(~np.asarray(held.combine_chunks()), np.diff(at))


def counts_of(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, how often each is learned, and the place of each key among them; the key 0 is none."""
    distinct, place = np.unique(keys, return_inverse=True)
    place = place.reshape(keys.shape).astype(np.int32)
    n = np.bincount(place[..., learn].ravel() if keys.ndim > 1 else place[learn], minlength=len(distinct))
    if len(distinct) and not distinct[0]:
        n[0] = 0
    return distinct, n, place


def asks(keys: np.ndarray, counts: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, its keys, their counts)."""
    first = int(len(keys) > 0 and not keys[0])
    part = ((keys >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)
    new = first + np.flatnonzero(np.diff(part[first:], prepend=-1))
    for i, j in zip(new.tolist(), np.append(new[1:], len(keys)).tolist()):
        yield int(part[i]), pack_keys(keys[i:j]), pack_counts(counts[i:j])


class Chunk:
    """The automaton of some texts: sorted n-grams, how often training texts hold each, and where each place's stand among them."""

    def __init__(self, text: pa.Array, held: pa.Array) -> None:
        grams, self.at = token_grams(*flat(text))
        self.keys, self.counts, self.place = counts_of(grams, learned(held, self.at))

    def learn(self, keys: bytes, counts: bytes) -> None:
        self.counts[np.searchsorted(self.keys, unpack_keys(keys))] = unpack_counts(counts)

    def traverse(self, one: np.ndarray, priors: tuple[float, ...], texts: int) -> np.ndarray:
        """log10 of each token's probability; one: that of the empty context's arcs; texts: how often the begin was seen."""
        starts = self.at[:-1][np.diff(self.at) > 0]
        arc = one
        for order, prior in ((1, priors[1]), (2, priors[2])):
            seen = self.counts[self.place[order]]  # of the arc from the state of order tokens
            context = np.roll(self.counts[self.place[order - 1]], 1)  # of that state
            context[starts] = texts if order == 1 else 0  # after the begin alone there is no longer context
            fail = np.log10(prior / (context + prior))  # nothing to lose in a state that was never seen
            arc = np.where(seen > 0, np.log10((seen + prior * 10**arc) / (context + prior)), fail + arc)
        return arc


ASKS = "part long, chunk long, keys binary, counts binary"


def asked(rows: Iterator[tuple[int, bytes, bytes]], chunk: int) -> pa.Table:
    rows = list(rows)
    cols = [[r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("part", "chunk", "keys", "counts"), cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))})


def whole(group: pa.Table, name: str, unpack: Callable[[bytes], np.ndarray]) -> list[np.ndarray]:
    return [unpack(x.as_buffer().to_pybytes()) for x in group[name]]


def answered(asking: DataFrame) -> DataFrame:
    """(chunk, tokens, keys, counts, n, v): for each chunk the n-grams of so many tokens that others ask for too, with all their counts; without a chunk, tokens and distinct tokens of a range."""

    def meet(group: pa.Table) -> pa.Table:
        came, own = whole(group, "keys", unpack_keys), np.concatenate(whole(group, "counts", unpack_counts))
        ends = np.cumsum([0, *map(len, came)])
        keys = np.concatenate(came)
        del came
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        sums, n = np.add.reduceat(own[order], new), np.diff(np.append(new, len(keys)))
        word = (keys[order[new]] & U64(3)) == 1
        total, several = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        total[order], several[order] = np.repeat(sums, n), np.repeat(n > 1, n)
        out = []
        for chunk, i, j in zip(group["chunk"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            more = i + np.flatnonzero(several[i:j])
            for tokens in (1, 2, 3):
                own_ = more[keys[more] & U64(3) == tokens]
                if len(own_):
                    out.append((chunk, tokens, pack_keys(keys[own_]), pack_counts(total[own_]), None, None))
        out.append((None, None, None, None, int(sums[word].sum()), int((sums[word] > 0).sum())))
        kinds = {"chunk": pa.int64(), "tokens": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "n": pa.int64(), "v": pa.int64()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), zip(*out))})

    return asking.groupBy("part").applyInArrow(meet, "chunk long, tokens int, keys binary, counts binary, n long, v long")


def words_and_pairs(docs: DataFrame, n_parts: int) -> DataFrame:
    def ask(group: pa.Table) -> pa.Table:
        rows = rows_of(group)
        grams, at = token_grams(*flat(rows["text"]))
        keys, counts, _ = counts_of(grams[:2], learned(rows["held_out"], at))
        return asked(asks(keys, counts, n_parts), group["chunk"][0].as_py())

    return answered(docs.groupBy("chunk").applyInArrow(ask, ASKS))


def threes(docs: DataFrame, answers: DataFrame, n_parts: int) -> DataFrame:
    """The n-grams of three whose pairs both were answered."""

    def ask(group: pa.Table, given: pa.Table) -> pa.Table:
        if not len(group) or not len(given):
            return asked(iter(()), 0)
        rows = rows_of(group)
        grams, at = token_grams(*flat(rows["text"]))
        known = np.sort(np.concatenate(whole(given, "keys", unpack_keys)))
        shared = known[np.minimum(np.searchsorted(known, grams[1]), max(0, len(known) - 1))] == grams[1] if len(known) else np.zeros(grams.shape[1], bool)
        good = np.flatnonzero(shared & np.roll(shared, 1) & (grams[2] > 0))
        keys, counts, _ = counts_of(grams[2, good], learned(rows["held_out"], at)[good])
        return asked(asks(keys, counts, n_parts), group["chunk"][0].as_py())

    pairs = answers.filter("tokens = 2").select("chunk", "keys")
    return answered(docs.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(ask, ASKS))


def score(docs: DataFrame, priors: tuple[float, ...] = PRIORS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("texts")).first()
    n_parts, texts = 1 + size["bytes"] // chunk_bytes, size["texts"]
    docs = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).alias("chunk"), "doc_id", "held_out", "text").mapInArrow(lean(squeezed), "chunk long, blob binary")
    first = cut(words_and_pairs(docs, n_parts))
    tidy(docs.sparkSession)
    sums = first.filter("chunk IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    given = first.filter("chunk IS NOT NULL").select("chunk", "tokens", "keys", "counts")
    more = cut(threes(docs, given, n_parts))
    tidy(docs.sparkSession)
    given = given.union(more.filter("chunk IS NOT NULL").select("chunk", "tokens", "keys", "counts")).drop("tokens")
    shift = math.log10(total + 0.5 * (distinct + 1))

    def run(group: pa.Table, given: pa.Table) -> pa.Table:
        rows = rows_of(group)
        chunk = Chunk(rows["text"], rows["held_out"])
        for keys, counts in zip(given["keys"], given["counts"]):
            chunk.learn(keys.as_buffer().to_pybytes(), counts.as_buffer().to_pybytes())
        n = chunk.counts[chunk.place[0]]
        arcs = chunk.traverse(np.log10((n + priors[0] / (distinct + 1)) / (total + priors[0])), priors, texts)
        sums = lambda x: np.add.reduceat(x, chunk.at[:-1])  # a text's sum, whatever stands beside it
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": np.diff(chunk.at), "n_known": sums((n > 0).astype(np.int64)), "train_tokens": np.full(len(rows), total), "base_score": sums(np.log10(n + 0.5) - shift), "score": sums(arcs)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(run, schema)
