"""Repeated windows across a corpus: what the two substring operators share.

A window is ``length`` consecutive units (words or bytes) of one document.  Both
operators need, for every window, whether the same string of units starts
somewhere else.  Work on every suffix of the corpus would shuffle the text many
times over, so suffixes are taken up only where a repeat is possible:

1. Every window elects an anchor: the ``gram`` consecutive units within it whose
   hash is least (the first of equals).  Equal windows elect equal anchors at the
   same place, wherever they stand, so a window can only repeat where its anchor
   does.  One in about (length - gram + 2) / 2 positions is an anchor.
2. Anchors are dealt out by hash.  Those found once in the corpus end there.
3. For the others the units around the anchor, as far as its windows reach, are
   dealt out by the anchor: a group holds all suffixes that start with (or, to
   its left, lead up to) the same units.  A block function sorts the suffixes of
   the groups of one task and says which windows repeat.
4. The covered spans go back to their documents.

Groups are memory-sized.  Before all this, anchors are counted: every task
reports those it has seen often, and the ones that stand more than GROUP_BYTES
of surroundings allow in the corpus are hot.  They are GROUP_KEYS at most.  The
suffixes of a hot anchor get a longer prefix: each of its windows is dealt out by
the 128-bit hash of all its units, and a task asks once for each window that it
holds, so neither a window nor an anchor that a third of the documents share
meets in one task.

Documents with equal texts are one text throughout: the text shuffle keeps one
of each by a partial aggregate, so that a text that a third of the rows repeat
costs one row per task.  Anchors and surroundings that repeat within a task are
sent once as well, and the others are known to repeat without asking.  Nothing
is capped.

Texts go by a 64-bit key, which is salted until no two texts that differ in 128
bits of hash and in length share it.  Words and anchors go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import U64, byte_symbols, cut, flat, gram_hash, lean, mix, pack, parts_for, prefix_sums, slices, span_hash, unpack, word_hashes, word_spans

#: Anchors and surroundings that a task gathers before it sends them on, in bytes.
HELD_BYTES = 32 << 20
#: Surroundings of one anchor that meet in a task, in bytes, and anchors that can be hot.
GROUP_BYTES, GROUP_KEYS = 4 << 20, 1_000_000
LAST_ID = (1 << 63) - 1

#: (windows, groups, order, place of the first column, first and last offset of the windows, units) -> which windows, by the column they start in, repeat and go.
Block = Callable[["Windows", np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Windows:
    unit: str  # "word" or "byte"
    length: int
    gram: int
    first_stays: bool  # whether the earliest of equal windows is left alone
    block: Block
    group_bytes: int = GROUP_BYTES

    @property
    def columns(self) -> int:
        """Units around an anchor that its windows can reach."""
        return self.width - 1 + self.length

    @property
    def row_bytes(self) -> int:
        return 36 + self.columns * (1 if self.unit == "byte" else 8)

    @property
    def width(self) -> int:
        """Anchors that a window chooses from."""
        return self.length - self.gram + 1

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is hashed, what is compared, and the documents' offsets, in units."""
        if self.unit == "byte":
            return byte_symbols(data), data, offsets
        s, e, words = word_spans(data, offsets)
        h = word_hashes(data, s, e)
        return h, h, words


def anchors(hashed: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """doc, place, first and last window start, hash of every anchor of the documents at offsets."""
    n_windows = np.maximum(0, np.diff(offsets) - w.length + 1)
    total = int(n_windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = gram_hash(hashed, w.gram)
    bits = U64(len(hashed).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w.width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w.width > span:
        least = np.minimum(least[: span - w.width], least[w.width - span :])
    start = np.repeat(offsets[:-1] - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(total)
    at = (least[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], total) - 1
    place = at[first]
    doc = np.searchsorted(offsets, place, "right") - 1
    return doc, place, start[first], start[last], grams[place]


def content_key(salt: int = 0) -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(F.lit(salt), text) if salt else F.xxhash64(text)


def safe_salt(docs: DataFrame) -> int:
    """The first salt with which no two texts share a key, by 128 bits and their lengths."""
    text = F.coalesce("text", F.lit(""))
    for salt in range(64):
        told = docs.select(content_key(salt).alias("key"), F.struct(F.xxhash64(F.lit("other"), text).alias("h"), F.octet_length(text).alias("n")).alias("more"))
        if told.groupBy("key").agg(F.min("more").alias("p"), F.max("more").alias("q")).filter("p <> q").isEmpty():
            return salt
    raise ValueError("texts share their keys whatever the salt")


def texts_of(docs: DataFrame, salt: int) -> DataFrame:
    """One row for each distinct text: content, the smallest and largest doc_id that has it (a null one counts as LAST_ID), the text."""
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    keyed = docs.select(node.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), content_key(salt).alias("content"))
    return keyed.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.first("text").alias("text"))


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in sorted_keys."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def hot_anchors(docs: DataFrame, w: Windows) -> np.ndarray:
    """The sorted keys of the anchors that too many suffixes share for one group; GROUP_KEYS at most.

    A task reports what it has seen at least `least` times.  What all tasks leave
    unreported of a key is less than a limit together, so a group that is not
    hot holds less than two limits.
    """
    limit = max(2, w.group_bytes // w.row_bytes)
    least = max(2, limit // max(1, docs.rdd.getNumPartitions()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for b in batches:
            data, offsets = flat(b["text"])
            for lo, hi in slices(offsets):
                hashed, _, units = w.read(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                key = anchors(hashed, units, w)[4]
                total += len(key)
                held.append(np.unique(key, return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merged_counts(held)]
        key, n = merged_counts(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = n >= least
        yield pa.RecordBatch.from_arrays([pa.array([None, *key[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())], ["key", "n"])

    reports = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(count), "key long, n long")
    sums = cut(reports.groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") > limit) | F.col("key").isNull()))
    total = sums.filter("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = sums.filter(F.col("key").isNotNull() & (F.col("n") > total // GROUP_KEYS)).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def merged_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)


def repeated_anchors(texts: DataFrame, w: Windows, n_parts: int) -> DataFrame:
    """(content, places): the anchors of each text that stand elsewhere too."""

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, content, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, content, place = key[order], content[order], place[order]
        new = np.append(True, key[1:] != key[:-1])
        twice = ~new
        twice[:-1] |= ~new[1:]
        rows: list[tuple[int, bool, bytes]] = []
        for known, mask, part in ((False, new, key % U64(n_parts)), (True, twice, content.view(np.uint64) % U64(n_parts))):
            k, c, p, q = key[mask], content[mask], place[mask].astype(np.uint32), part[mask].astype(np.int64)
            order = np.argsort(q, kind="stable")
            k, c, p, q = k[order], c[order], p[order], q[order]
            edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
            rows += [(int(q[i]), known, pack(k[i:j], c[i:j], p[i:j])) for i, j in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["part", "known", "blob"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, offsets = flat(b["text"])
            content = b["content"].to_numpy()
            for lo, hi in slices(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashed, _, units = w.read(part, off)
                doc, place, _, _, key = anchors(hashed, units, w)
                if len(doc):
                    held.append((key, content[lo + doc], place - units[doc]))
                    size += 24 * len(doc)
                if size > HELD_BYTES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def meet(group: pa.Table) -> pa.Table:
        known = [unpack(x.as_py(), "u8", "i8", "u4")[1:] for x, k in zip(group["blob"], group["known"].to_pylist()) if k]
        asked = [unpack(x.as_py(), "u8", "i8", "u4") for x, k in zip(group["blob"], group["known"].to_pylist()) if not k]
        if asked:
            key, content, place = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(key, kind="stable")
            new = np.append(True, np.diff(key[order]) != 0)
            twice = ~new
            twice[:-1] |= ~new[1:]
            known.append([content[order][twice], place[order][twice]])
        content, place = (np.concatenate(x) for x in zip(*known))
        return pa.table({"content": pa.array(content, pa.int64()), "place": pa.array(place.astype(np.int32), pa.int32())})

    sent = texts.mapInArrow(lean(find), "part long, known boolean, blob binary")
    met = sent.groupBy("part").applyInArrow(meet, "content long, place int")
    return met.groupBy("content").agg(F.collect_list("place").alias("places"))


class Sender:
    """What a task has gathered around its anchors, and sends on without repeats."""

    def __init__(self, w: Windows, n_parts: int) -> None:
        self.w, self.n_parts, self.size = w, n_parts, 0
        self.around: list[tuple[np.ndarray, ...]] = []
        self.windows: list[tuple[np.ndarray, ...]] = []

    def add(self, around: tuple[np.ndarray, ...] | None = None, windows: tuple[np.ndarray, ...] | None = None) -> None:
        if around is not None:
            self.around.append(around)
            self.size += self.w.row_bytes * len(around[0])
        if windows is not None:
            self.windows.append(windows)
            self.size += 36 * len(windows[0])

    def dealt(self, kind: int, key: np.ndarray, arrays: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        part = (key % U64(self.n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        return [(int(part[i]), kind, pack(*(x[order[i:j]] for x in arrays))) for i, j in zip(edges[:-1], edges[1:])]

    def sure(self, content: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
        if not len(content):
            return []
        return [(int(content[0]) % self.n_parts, SURE, pack(content, start.astype(np.uint32), end.astype(np.uint32)))]

    def send(self) -> pa.RecordBatch:
        w, rows = self.w, []
        if self.around:
            key, content, order, place, first, last, around = (np.concatenate(x) for x in zip(*self.around))
            o = np.lexsort((place, content, order))
            key, content, order, place, first, last, around = (x[o] for x in (key, content, order, place, first, last, around))
            whole = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(len(key), -1) for x in (key, first, last, around)], axis=1))
            _, index, inverse, count = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
            again = np.ones(len(key), bool)
            again[index] = False  # the earliest of equal surroundings asks for all of them
            sure = again if w.first_stays else (count > 1)[inverse]
            rows += self.sure(content[sure], (place - last)[sure], (place - first)[sure] + w.length)
            ask = np.flatnonzero(~again)
            rows += self.dealt(AROUND, key[ask], [key[ask], content[ask], order[ask], *(x[ask].astype(np.uint32) for x in (place, first, last)), around[ask]])
        if self.windows:
            key, more, content, order, start = (np.concatenate(x) for x in zip(*self.windows))
            o = np.lexsort((start, content, order, more, key))
            key, more, content, order, start = (x[o] for x in (key, more, content, order, start))
            again = np.append(False, (key[1:] == key[:-1]) & (more[1:] == more[:-1]))
            sure = again.copy()
            if not w.first_stays:
                sure[:-1] |= again[1:]
            rows += self.sure(content[sure], start[sure], start[sure] + w.length)
            ask = np.flatnonzero(~again)
            rows += self.dealt(WINDOW, key[ask], [key[ask], more[ask], content[ask], order[ask], start[ask].astype(np.uint32)])
        self.around, self.windows, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["part", "kind", "blob"])


#: What a row of a task says: units around anchors, windows of hot anchors, spans known to repeat.
AROUND, WINDOW, SURE = 0, 1, 2


def covered_spans(texts: DataFrame, repeated: DataFrame, w: Windows, hot: np.ndarray, n_parts: int) -> DataFrame:
    """(content, spans): the units to be removed from each text, each span packed as start << 32 | end."""
    cols = w.columns
    kind = np.dtype("u1") if w.unit == "byte" else np.dtype("u8")
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, hot_keys = Sender(w, n_parts), shared.value
        for b in batches:
            data, offsets = flat(b["text"])
            content, order = b["content"].to_numpy(), b["first_id"].to_numpy()
            places = b["places"]
            wanted = np.asarray(places.flatten(), np.int64) + np.repeat(np.arange(len(b)) << 32, np.diff(np.asarray(places.offsets)))
            wanted.sort()
            for lo, hi in slices(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashed, units, at = w.read(part, off)
                doc, place, start, stop, key = anchors(hashed, at, w)
                keep = among(wanted, (lo + doc << 32) + place - at[doc])
                often = keep & among(hot_keys, key)
                if often.any():
                    sums, more = prefix_sums(hashed), prefix_sums(mix(hashed + U64(0x51ED)))
                    n = (stop - start + 1)[often]
                    first = np.repeat(start[often] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    own = np.repeat(doc[often], n)
                    sender.add(windows=(span_hash(sums, first, first + w.length), span_hash(more, first, first + w.length), content[lo + own], order[lo + own], first - at[own]))
                keep = np.flatnonzero(keep & ~often)
                doc, place, start, stop, key = doc[keep], place[keep], start[keep], stop[keep], key[keep]
                for x in range(0, len(doc), 20_000):
                    y = slice(x, x + 20_000)
                    index = place[y, None] + np.arange(cols) - (w.width - 1)
                    inside = (index >= start[y, None]) & (index < stop[y, None] + w.length)
                    around = np.where(inside, units[np.clip(index, 0, len(units) - 1)], kind.type(0))
                    sender.add((key[y], content[lo + doc[y]], order[lo + doc[y]], place[y] - at[doc[y]], (place - stop)[y], (place - start)[y], around))
                    if sender.size > HELD_BYTES // 2:
                        yield sender.send()
                if sender.size > HELD_BYTES // 2:
                    yield sender.send()
        if sender.size:
            yield sender.send()

    def meet_around(asked: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        key, content, order, place, first, last, around = (np.concatenate(x) for x in zip(*asked))
        place, first, last = (x.astype(np.int64) for x in (place, first, last))
        around = around.view(kind).reshape(len(key), cols)
        _, g, count = np.unique(key, return_inverse=True, return_counts=True)
        live = np.flatnonzero(count[g] > 1)
        if not len(live):
            return content[:0], place[:0], place[:0]
        turn = np.empty(len(key), np.int64)
        turn[np.lexsort((place, content, order))] = np.arange(len(key))
        base = place[live] - (w.width - 1)
        gone = w.block(w, g[live], turn[live], base, first[live], last[live], around[live])
        edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return content[live][r], base[r] + s, base[r] + e - 1 + w.length

    def meet_windows(asked: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        key, more, content, order, start = (np.concatenate(x) for x in zip(*asked))
        o = np.lexsort((start, content, order, more, key))
        again = np.append(False, (key[o][1:] == key[o][:-1]) & (more[o][1:] == more[o][:-1]))
        gone = again.copy()
        if not w.first_stays:
            gone[:-1] |= again[1:]
        found = o[gone]
        return content[found], start[found].astype(np.int64), start[found].astype(np.int64) + w.length

    def meet(group: pa.Table) -> pa.Table:
        layout = {AROUND: ("u8", "i8", "i8", "u4", "u4", "u4", f"V{kind.itemsize * cols}"), WINDOW: ("u8", "u8", "i8", "i8", "u4"), SURE: ("i8", "u4", "u4")}
        came: dict[int, list[list[np.ndarray]]] = {k: [] for k in layout}
        for blob, k in zip(group["blob"], group["kind"].to_pylist()):
            came[k].append(unpack(blob.as_py(), *layout[k]))
        out = [tuple(x) for x in came[SURE]]
        if came[AROUND]:
            out.append(meet_around(came[AROUND]))
        if came[WINDOW]:
            out.append(meet_windows(came[WINDOW]))
        content, s, e = (np.concatenate([np.asarray(x[i], np.int64) for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"content": content, "span": (s << 32) | e})

    sent = texts.join(repeated, "content").mapInArrow(lean(gather), "part long, kind int, blob binary")
    met = sent.groupBy("part").applyInArrow(meet, "content long, span long")
    return met.groupBy("content").agg(F.collect_list("span").alias("spans"))


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n units the spans cover."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, spans >> 32, 1)
    np.add.at(turns, spans & 0xFFFFFFFF, -1)
    return np.cumsum(turns[:-1]) > 0


def remove_repeats(docs: DataFrame, w: Windows, salt: int, finish: Callable[[bytes, np.ndarray], tuple], schema: str) -> DataFrame:
    """A row for each distinct text: content, first_id, last_id and what finish(text, spans) returns.

    finish() gets every text with its spans; its columns are named in schema.
    """
    texts, n_parts = texts_of(docs, salt), parts_for(docs)
    spans = covered_spans(texts, repeated_anchors(texts, w, n_parts), w, hot_anchors(docs, w), n_parts)
    names = ["content", "first_id", "last_id", *[x.strip().split(" ")[0] for x in schema.split(",")]]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for text, x in zip(b["text"], b["spans"]):
                out.append(finish(text.as_buffer().to_pybytes(), np.asarray(x.values, np.int64) if x.is_valid else none))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b["content"], b["first_id"], b["last_id"], *cols], names)

    return texts.join(spans, "content", "left").mapInArrow(lean(run), f"content long, first_id long, last_id long, {schema}")
