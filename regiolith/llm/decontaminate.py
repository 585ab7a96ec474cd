"""Benchmark decontamination: approximate copies of benchmark items within documents.

Texts are compared as lower-cased words joined by single spaces.  A document
holds an item when some substring of it is within MAX_EDITS edits a character
of the item.

1. Windows.  A window is taken wherever enough q-grams of an item stand moved by
   about the same distance: in two neighbouring strips of distances.  Items under
   60 bytes need the m - q + 1 - k * q grams that k edits leave at least, in strips
   wider than k, which loses no copy.  Longer ones need SHARE of those 5-byte grams
   that are looked for, the half that is rarest in the benchmark, in strips as wide
   as the distance that random edits make; of these only edits at even distances
   of five bytes leave too few.
2. Embedding.  Windows and items are embedded by CGK random walks: at step j the
   walk emits the current byte and moves on by a random bit of (j, byte).  Edits
   that the walks get over leave the rest of the embeddings equal, so a small
   edit distance becomes a small Hamming distance.
3. Bit-sampling LSH.  Each of WALKS walks has TABLES tables, keyed by SAMPLES
   positions of the embedding; a window's candidates are the item whose q-grams
   it holds and all items that share its key in AGREE tables or more.
4. Every candidate is verified by bit-parallel edit distance (exact), with free
   ends in the text around the window.

The benchmark is a stated query set: it goes to the workers in blocks of at most
BLOCK_BYTES, each against all documents; a block is the only thing broadcast.

Rows: null and empty texts hold nothing; null and empty items are never found.
Of items that repeat each is found under its own id; rows of documents that
repeat each get their result.  A row without matches is absent from matches()
and kept by without_leaks().  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import LOWER, U64, flat, lean, mix, prepare, random_words, row_key, slices, unused, word_spans

MAX_EDITS = 0.2
WALKS, TABLES, SAMPLES = 24, 32, 3
#: Tables in which a candidate shares the window's key, at least: by chance one item in 200 does, at a tenth of the characters edited 94 % do.
AGREE = 4
BLOCK_BYTES = 4 << 20
HELD_WINDOWS = 1_500
#: Buckets of q-grams (those that share one count for each other, which adds windows only), strips counted and q-grams met at once.
BUCKET_BITS, STRIPS, MET = 20, 4 << 20, 2 << 20
#: The width of q-grams by an item's least size.
WIDTHS = ((60, 5), (30, 3), (4, 2), (1, 1))
SHARE = 0.11
#: Of the 5-byte grams of an item one in so many is looked for, the rarest ones.
RAREST = 2


def normal(data: bytes) -> bytes:
    return b" ".join(data.translate(LOWER.tobytes()).split())


def normal_slice(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normal() of all documents of lower-cased bytes, each with a line feed after it, and the n + 1 offsets into that."""
    s, e, at = word_spans(part, offsets)
    size = e - s + 1  # with the blank or line feed after each word
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(ends[-1], 0x20, np.uint8)
    fill = np.ones(len(out), bool)
    fill[ends[1:] - 1] = False
    inside = np.zeros(len(part) + 1, np.int8)
    inside[s] += 1  # starts differ from each other, and so do ends
    inside[e] -= 1
    out[fill] = part[np.cumsum(inside[:-1]) > 0]
    last = at[1:][at[1:] > at[:-1]]
    out[ends[last] - 1] = 0x0A
    return out, ends[at]


def gram_buckets(data: np.ndarray, width: int) -> np.ndarray:
    """The bucket of every width consecutive bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code << U64(8) | data[k : k + n]
    return (code * U64(0x9E3779B97F4A7C15) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def strip_of(size: int) -> tuple[int, int]:
    """The width of an item's q-grams and the bits of its strips' width."""
    width, edits = next(width for least, width in WIDTHS if size >= least), int(MAX_EDITS * size)
    return width, max(3, (math.isqrt(edits) - 1).bit_length()) if width == WIDTHS[0][1] else edits.bit_length()


class Strips:
    """The items that are looked for by q-grams of one width in strips of 2^shift distances."""

    def __init__(self, own: list[int], texts: list[bytes], width: int, shift: int) -> None:
        self.own, self.width, self.shift = np.array(own), width, shift
        self.size = np.array([len(texts[i]) for i in own])
        self.edits = np.array([int(MAX_EDITS * m) for m in self.size])
        grams = [gram_buckets(np.frombuffer(texts[i], np.uint8), width) for i in own]
        if width == WIDTHS[0][1]:
            often = np.bincount(np.concatenate(grams), minlength=1 << BUCKET_BITS)
            places = [np.sort(np.lexsort((g, often[g]))[: -(-len(g) // RAREST)]) for g in grams]
            self.need = np.ceil(SHARE * np.array([len(p) for p in places])).astype(int)
        else:
            places = [np.arange(len(g)) for g in grams]
            self.need = self.size - width + 1 - width * self.edits
        bucket, item = np.concatenate([g[p] for g, p in zip(grams, places)]), np.repeat(np.arange(len(own)), [len(p) for p in places])
        place = np.concatenate(places)
        order = np.argsort(bucket, kind="stable")
        self.item, self.place = item[order], place[order]
        self.start = np.searchsorted(bucket[order], np.arange((1 << BUCKET_BITS) + 1))
        self.has = np.diff(self.start) > 0
        self.longest = int(self.size.max())
        self.overlap = 4 * self.longest + 16
        self.step = max(4 * self.overlap, min(1 << 18, (STRIPS << shift) // len(own)))

    def windows(self, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, from, to): where an item seems to start in data, and the bytes within which a copy would stand."""
        for lo in range(0, max(1, len(data)), self.step):
            part = data[lo : lo + self.step + self.overlap]
            for item, start, left, right in self._windows(part):
                yield item, lo + start, max(0, lo + left), min(len(data), lo + right)

    def _windows(self, part: np.ndarray) -> list[tuple[int, int, int, int]]:
        bucket = gram_buckets(part, self.width)
        at = np.flatnonzero(self.has[bucket])
        first = self.start[bucket[at]]
        n = self.start[bucket[at] + 1] - first
        strips = (len(part) + self.longest >> self.shift) + 2  # an item's last one is empty
        entry = (self.item * strips << self.shift) + self.longest - self.place
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        found: list[tuple[np.ndarray, ...]] = []
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + MET, "right")) - 1)
            x = np.repeat(first[i:j] - (ends[i:j] - ends[i]), n[i:j])
            x += np.arange(len(x))
            spot = np.repeat(at[i:j], n[i:j]) + entry[x]  # strip of an item << shift | distance in the strip, for each gram met
            spot.sort()
            strip = spot >> self.shift
            new = np.flatnonzero(np.append(True, strip[1:] != strip[:-1]))
            found.append((strip[new], np.diff(np.append(new, len(spot))), np.add.reduceat(spot % (strips << self.shift), new)))
            i = j
        if not found:
            return []
        cell, count, sums = found[0]
        if len(found) > 1:
            cell, own = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            count, sums = (np.bincount(own, np.concatenate([f[k] for f in found])).astype(np.int64) for k in (1, 2))

        def two(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The values of a strip and the next together."""
            out = np.zeros(len(at), np.int64)
            for c in (at, at + 1):
                k = np.minimum(np.searchsorted(cell, c), len(cell) - 1)
                out += np.where(cell[k] == c, values[k], 0)
            return out

        half = cell[count >= (int(self.need.min()) + 1) // 2]  # one of two strips has half
        good = np.unique(np.concatenate([half, half[half > 0] - 1]))
        good = good[two(count, good) >= self.need[np.minimum(good // strips, len(self.own) - 1)]]
        if not len(good):
            return []
        item, both = good // strips, two(count, good)
        new = np.flatnonzero(np.append(True, (np.diff(good) > 1) | (np.diff(item) > 0)))  # strips in a row are one window
        last = np.append(new[1:], len(good)) - 1
        best = np.lexsort((-both, np.repeat(new, last - new + 1)))[new]
        start = (two(sums, good) // both)[best] - self.longest
        left = (good[new] % strips << self.shift) - self.longest - self.edits[item[new]]
        item = item[new]
        right = (good[last] % strips + 2 << self.shift) - self.longest + self.size[item] + 2 * self.edits[item]
        return list(zip(self.own[item].tolist(), start.tolist(), left.tolist(), right.tolist()))


def edit_distance(pattern: bytes, text: bytes) -> int:
    """The least edits that turn pattern into some substring of text (Myers' bit-parallel columns)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | minus
        d = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(d | plus) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
        best = min(best, score)
    return best


class Index:
    """The items of a block: their q-grams by width, and their keys in every table."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.ids, self.texts = ids, texts
        dealt: dict[tuple[int, int], list[int]] = {}
        for i, t in enumerate(texts):
            dealt.setdefault(strip_of(len(t)), []).append(i)
        self.strips = [Strips(own, texts, *kind) for kind, own in dealt.items()]
        keys = sample_keys(texts)
        self.lsh_item = np.repeat(np.arange(len(texts)), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.lsh_keys, self.lsh_item = keys.ravel()[order], self.lsh_item[order]

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, start, from, to) of every window of the normal texts of documents."""
        for strips in self.strips:
            for item, start, left, right in strips.windows(data):
                lo = max(0, int(np.searchsorted(offsets, left, "right")) - 1)
                for doc in range(lo, int(np.searchsorted(offsets, right, "left"))):
                    a, b = int(offsets[doc]), int(offsets[doc + 1]) - 1
                    if b > a and min(right, b) > max(left, a):
                        yield doc, item, min(max(start, a), b - 1), max(left, a), min(right, b)

    def candidates(self, texts: list[bytes]) -> list[list[int]]:
        """For each window the items that share its key in AGREE tables."""
        keys = sample_keys(texts)
        lo, hi = (np.searchsorted(self.lsh_keys, keys.ravel(), side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, count = np.unique(np.repeat(np.arange(len(n)) // max(1, keys.shape[1]), n) * len(self.texts) + self.lsh_item[at], return_counts=True)
        out: list[list[int]] = [[] for _ in texts]
        for p in pair[count >= AGREE].tolist():
            out[p // len(self.texts)].append(p % len(self.texts))
        return out


_SPOTS = (random_words(WALKS * TABLES * SAMPLES, 21) >> U64(11)).astype(np.float64) / float(1 << 53)
_TABLE = random_words(WALKS * TABLES, 22)


def sample_keys(texts: list[bytes]) -> np.ndarray:
    """The keys of each text in every table, in embeddings of twice the text's length."""
    n = len(texts)
    if not n:
        return np.zeros((0, WALKS * TABLES), np.uint64)
    lens = np.array([len(t) for t in texts])
    wide = np.zeros((n, int(lens.max()) + 1), np.uint8)
    for i, t in enumerate(texts):
        wide[i, : len(t)] = np.frombuffer(t, np.uint8)
    steps, row = 2 * int(lens.max()), np.arange(n)
    keys = np.zeros((n, WALKS * TABLES), np.uint64)
    spots = (_SPOTS[None, :] * (2 * lens[:, None])).astype(np.int64).reshape(n, WALKS, TABLES, SAMPLES)
    for walk in range(WALKS):
        move = (random_words(steps * 256, 100 + walk) & U64(1)).astype(np.int64).reshape(steps, 256)
        emitted, at = np.zeros((n, max(1, steps)), np.uint8), np.zeros(n, np.int64)
        for j in range(steps):
            c = wide[row, at]
            emitted[:, j] = c
            at = np.minimum(at + move[j][c], lens)
        key = np.broadcast_to(_TABLE[walk * TABLES : (walk + 1) * TABLES], (n, TABLES)).copy()
        for k in range(SAMPLES):
            key = mix(key * U64(0x9E3779B97F4A7C15) + np.take_along_axis(emitted, spots[:, walk, :, k], axis=1).astype(np.uint64))
        keys[:, walk * TABLES : (walk + 1) * TABLES] = key
    return keys


def search(docs: DataFrame, index: Index) -> DataFrame:
    """row, doc_id, item_id, word (where the window starts), distance of every document and item of the index that match."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = ["row", "doc_id", "item_id", "word", "distance", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        held: list[tuple[str, int | None, int, int, bytes, bytes]] = []

        def send() -> Iterator[pa.RecordBatch]:
            best: dict[tuple[str, int | None, int], tuple[int, int]] = {}
            for (row, doc, word, item, _, around), more in zip(held, own.candidates([x[4] for x in held])):
                for found in {item, *more}:
                    pattern = own.texts[found]
                    most = int(MAX_EDITS * len(pattern))
                    d = edit_distance(pattern, around)
                    if d <= most:
                        key = (row, doc, found)
                        best[key] = min(best.get(key, (d, word)), (d, word))
            cols = zip(*[(row, doc, own.ids[item], word, d, len(own.texts[item])) for (row, doc, item), (d, word) in best.items()]) if best else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(cols)], names)

        for b in batches:
            data, offsets = flat(b["text"])
            rows, ids = b["row"].to_pylist(), b["doc_id"].to_pylist()
            for lo, hi in slices(offsets):
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                text, at = normal_slice(part, offsets[lo : hi + 1] - offsets[lo])
                ends = np.flatnonzero(text <= 0x20)  # after each word
                for doc, item, start, left, right in own.windows(text, at):
                    word = int(np.searchsorted(ends, start) - np.searchsorted(ends, at[doc]))
                    held.append((rows[lo + doc], ids[lo + doc], word, item, text[start : min(start + len(own.texts[item]), at[doc + 1] - 1)].tobytes(), text[left:right].tobytes()))
            if len(held) > HELD_WINDOWS:  # at a batch's end, so a document's windows are together
                yield from send()
                held.clear()
        if held:
            yield from send()

    return docs.select("row", "doc_id", "text").mapInArrow(lean(run), "row string, doc_id long, item_id long, word long, distance long, size long")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, item_id, word, distance, similarity: the best window for each document that holds an item."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key("doc_id", "text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for i in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect() if size else []
        own = sorted({(r["item_id"], normal(r["text"].encode())) for r in own if r["item_id"] is not None and r["text"].split()})
        index = Index([i for i, t in own if t], [t for _, t in own if t])
        found = search(docs, index)
        out = found if out is None else out.union(found)
    return out.select("row", "doc_id", "item_id", "word", "distance", F.round(1 - F.col("distance") / F.col("size"), 6).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that hold an item."""
    row, text, key = (unused(docs, x) for x in ("row_found", "text_of_row", "key_of_row"))
    found = matches(docs, benchmark).select(F.col("row").alias(row)).distinct()
    id_ = unused(docs, "id_of_row")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(text, F.coalesce("text", F.lit("")))
    keyed = keyed.withColumn(key, row_key(id_, text)).drop(id_, text)
    return keyed.join(found, F.col(key) == F.col(row), "left_anti").drop(key)
