"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

A document's set is its distinct shingles of five lower-cased words.  Documents
with equal sets form a class, of which one represents the others.

* Candidates: BANDS * ROWS MinHash values, ROWS to a band; two sets of
  similarity 0.75 share no band with probability (1 - 0.75^5)^44 < 7e-6.
* Odd sketch: every MinHash value flips one of SKETCH bits, so values that two
  documents share cancel in the exclusive or of their bitmaps.  The number of
  bits left estimates their similarity; MOST_BITS leaves room for five standard
  deviations below 0.75.
* Links are confirmed on the full sets.

Pairs within a band's bucket are never listed.  In a round, each bucket with two
components or more offers its members one hub, and every member meets at most
one: of the hubs offered in its buckets the one whose sketch is nearest.  Found
links merge components.  Rounds go on while a quarter of their pairs are links,
so their number grows with the logarithm of a group's size.  What is left then is
compared in full.  A member stays if its sketch allows a link with a member of
another component in one of its buckets: buckets of FEW members say so in a join,
larger ones in cells of two blocks each.  Cells of the members that stay count
the shingles that all pairs share by products of incidence matrices, and return a
forest: links that join the components of the cell, one less than there are of
them at most.  Blocks are bounded by members and by shingles, so a bucket of any
size is dealt to many tasks, and no link between components is left out.

Rows: a null text, and a text without words, has an empty set and no links; with
fewer than five words the whole sequence is one shingle.  Rows that share a
doc_id are one node.  Rows with a null doc_id are one node too, after all
others.  Ties and repeats need no rule, as components are smallest ids.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import LOWER, U64, cut, flat, gram_hash, lean, merged, mix, prefix_sums, prepare, random_words, slices, span_hash, tidy, unused, word_hashes, word_spans
from regiolith.llm.components import components
from regiolith.llm.repeats import LAST_ID

WORDS = 5
BANDS, ROWS = 44, 5
SKETCH = 512
#: Bits that may differ: 89 are expected at similarity 0.75, with a deviation of about 10.
MOST_BITS = 139
#: Rounds with hubs go on while this share of their pairs are links.
WORTH = 0.25
#: Members of a bucket that meet in a join; others do so in blocks of so many members and shingles; rows for a task.
FEW, BLOCK, BLOCK_SHINGLES, PART_ROWS = 48, 600, 1_000_000, 2500

#: Classes of more rows than this, and so many classes at most, are broadcast to their rows.
HOT_ROWS, HOT_CLASSES = 1000, 100_000

_XOR = random_words(BANDS * ROWS, 2).astype(np.uint32)
_TIMES = (random_words(BANDS * ROWS, 3) >> U64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = random_words(BANDS * ROWS, 4)
_BAND = random_words(BANDS, 5)
SKETCH_COLS = [f"s{i}" for i in range(SKETCH // 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    data = LOWER[data]
    s, e, words = word_spans(data, offsets)
    h = word_hashes(data, s, e)
    grams, sums = gram_hash(h, WORDS), prefix_sums(h)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= WORDS:
            g = np.sort(grams[a : b - WORDS + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        else:
            out.append(span_hash(sums, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def minhash(grams: np.ndarray) -> np.ndarray:
    x, out = (grams >> U64(32)).astype(np.uint32)[:, None], None
    for i in range(0, len(x), 512):
        v = x[i : i + 512] ^ _XOR
        v *= _TIMES
        v = v.min(axis=0)
        out = v if out is None else np.minimum(out, v)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """node, n_shingles, set_a and set_b (128 bits of the set), bands, and the sketch of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b["text"])
            parts = []
            for lo, hi in slices(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.array([len(x) for x in sets])
                sig = np.array([minhash(x) if len(x) else np.zeros(BANDS * ROWS, np.uint32) for x in sets], np.uint32)
                a = np.array([np.add.reduce(x) if len(x) else 0 for x in sets], np.uint64)
                c = np.array([np.add.reduce(mix(x + U64(77))) if len(x) else 0 for x in sets], np.uint64)
                wide = sig.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
                band = np.broadcast_to(_BAND, (len(sets), BANDS)).copy()
                for r in range(ROWS):
                    band = mix(band * U64(0x9E3779B97F4A7C15) + wide[:, :, r])
                bit = (mix(sig.astype(np.uint64) + _FLIP) >> U64(32)).astype(np.int64) % SKETCH
                odd = np.bincount((bit + np.arange(len(sets))[:, None] * SKETCH).ravel(), minlength=len(sets) * SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH), axis=1).view(np.int64)
                parts.append((n, a.view(np.int64), c.view(np.int64), band.view(np.int64), sketch))
            if not parts:
                continue
            n, a, c, band, sketch = (np.concatenate(x) for x in zip(*parts))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(n, pa.int64()), pa.array(a), pa.array(c), bands, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH_COLS)))], ["node", "n_shingles", "set_a", "set_b", "bands", *SKETCH_COLS])

    schema = "node long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH_COLS)
    return nodes(docs).mapInArrow(lean(run), schema)


def nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("node"), "text")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, size, grams): the full sets, 64 bits a shingle, of docs (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b["text"])
            out: list[np.ndarray] = []
            for lo, hi in slices(offsets):
                out += shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], ["node", "size", "grams"])

    return docs.mapInArrow(lean(run), "node long, size long, grams binary")


def unpack(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint64)


def alike(both: np.ndarray | int, left: np.ndarray | int, right: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return (both > 0) & (100 * both >= percent * (left + right - both))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                left, right = unpack(x), unpack(y)
                keep.append(bool(alike(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return merged(merged(pairs, y, "b"), x, "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct()


def cells(rows: DataFrame, blocks: Column, n_parts: int) -> DataFrame:
    """rows (key, node, ...), once for every cell (key, i, j) that its block, i or j, is in, and the part that the cell is dealt to."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    return rows.withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n_parts)))


def each_cell(group: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Every cell of a part, with the rows of its first and of its second block (all rows twice where they are one block)."""
    group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    key, i, j, own = (group[c].to_numpy() for c in ("key", "i", "j", "own"))
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    for a, b in zip(new.tolist(), np.append(new[1:], len(key)).tolist()):
        first = own[a:b] == i[a]
        yield group.slice(a, b - a), np.flatnonzero(first), np.flatnonzero(first if i[a] == j[a] else ~first)


def parts_of(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)


def able_in_blocks(rest: DataFrame) -> DataFrame:
    """(key, node, component) of the rows of rest whose sketch allows a link with another component of their bucket; rest has blocks and the sketch."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        for cell, left, right in each_cell(group):
            component = cell["component"].to_numpy()
            sketch = np.stack([cell[c].to_numpy() for c in SKETCH_COLS], axis=1).view(np.uint64)
            able = np.zeros(len(cell), bool)
            for lo in range(0, len(left), 64):
                x = left[lo : lo + 64]
                bits = np.bitwise_count(sketch[x][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
                near = (bits <= MOST_BITS) & (component[x][:, None] != component[right][None, :])
                able[x] |= near.any(axis=1)
                able[right] |= near.any(axis=0)
            out.append(cell.filter(pa.array(able)).select(["key", "node", "component"]))
        return pa.concat_tables(out)

    rows = cells(rest, F.col("blocks"), parts_of(rest, rest.count()))
    return rows.groupBy("part").applyInArrow(run, "key long, node long, component long").distinct()


def shared_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles the sets of left and of right share, by products of incidence matrices; rare shingles are added up pair by pair."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(left), len(right)), np.float32)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    rare = (count > 1) & (count < 24) & (len(sets) > 256)
    often = np.flatnonzero((count > 1) & ~rare)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    keep = place[name] >= 0
    at, who = place[name][keep], owner[keep]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    wide = max(64, (4 << 20) // len(sets))
    for lo in range(0, len(often), wide):
        x = slice(*np.searchsorted(at, [lo, lo + wide]))
        has = np.zeros((len(sets), min(wide, len(often) - lo)), np.float32)
        has[who[x], at[x] - lo] = 1
        both += has[left] @ has[right].T
    who = owner[rare[name]]
    who = who[np.argsort(name[rare[name]], kind="stable")]
    n = count[rare]
    start = np.cumsum(n) - n
    for k in range(1, 24):  # each holder with the k-th after it
        good = np.flatnonzero(np.repeat(n, n) > k + np.arange(len(who)) - np.repeat(start, n))
        for a, b in ((who[good], who[good + k]), (who[good + k], who[good])):
            own = (row[a] >= 0) & (col[b] >= 0)
            np.add.at(both, (row[a[own]], col[b[own]]), 1)
    return both


def forest(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the components of a cell that join them as all its links do."""
    kinds, kind = np.unique(component, return_inverse=True)
    if len(kinds) < 2 or not len(left) or not len(right):
        return
    lens = np.array([len(x) for x in sets], np.float64)
    both, root = shared_shingles(sets, left, right), np.arange(len(kinds))
    for x, shares in zip(left.tolist(), both):
        found = right[alike(shares.astype(np.float64), lens[x], lens[right], percent)]
        roots, first = np.unique(root[kind[found]], return_index=True)
        own = root[kind[x]]
        for r, y in zip(roots.tolist(), found[first].tolist()):
            if r != own:
                yield min(node[x], node[y]), max(node[x], node[y])
        if len(roots):
            root[np.isin(root, np.append(roots, own))] = min(own, roots[0])


def confirm_blocks(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that share a bucket in active (key, node, component)."""
    rows = cut(merged(active, sets.groupBy("node").agg(F.sum("size").alias("size")), "node"))
    size = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = merged(merged(rows.drop("size"), size, "key"), sets.drop("size"), "node")

    def run(group: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        for cell, left, right in each_cell(group):
            out.update(forest(cell["node"].to_numpy(), cell["component"].to_numpy(), [unpack(x) for x in cell["grams"]], left, right, percent))
        pairs = sorted(out)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return cells(rows, F.col("blocks"), parts_of(active, active.count())).groupBy("part").applyInArrow(run, "a long, b long").distinct()


def bits_apart(left: str, right: str) -> Column:
    return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in SKETCH_COLS])


def with_components(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members.withColumn("component", F.col("node"))
    return merged(members, label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))


def hub_pairs(labelled: DataFrame, sketches: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): for a member, of the hubs of its buckets that it has not met, the one with the nearest sketch."""
    hub = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("node"), F.col("component").alias("component")))
    several = labelled.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), hub.alias("hub")).filter("p < q")
    offered = merged(labelled, several, "key").filter("component <> hub.component").select(F.col("node").alias("own"), F.col("hub.node").alias("hub")).distinct()
    offered = offered.select("own", "hub", F.least("own", "hub").alias("a"), F.greatest("own", "hub").alias("b"))
    if tried is not None:
        offered = merged(offered, tried, ["a", "b"], "left_anti")
    left, right = sketches.alias("l"), sketches.alias("r")
    met = merged(merged(offered, left, F.col("own") == F.col("l.node")), right, F.col("hub") == F.col("r.node"))
    bits = bits_apart("l", "r")
    best = met.filter(bits <= MOST_BITS).groupBy("own").agg(F.min_by(F.struct("a", "b"), F.struct(bits.alias("bits"), F.col("hub"))).alias("best"))
    return best.select("best.a", "best.b").distinct()


def with_links(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """(a, b): new links, and those of each node with its component, which stand for all links found before."""
    if label is None:
        return new
    return new.union(label.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))


def links(docs: DataFrame, sig: DataFrame, percent: int = 75) -> DataFrame | None:
    """(node, component) of the classes that have links; None if no bucket holds two classes."""
    spark = docs.sparkSession
    classes = sig.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("node").alias("node")).select("node").distinct()
    first = merged(sig.filter("n_shingles > 0"), classes, "node", "left_semi")  # copies don't meet in buckets
    rows = first.select("node", "set_a", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("set_a").alias("p"), F.max("set_a").alias("q")).filter("p < q").select("key")
    members = cut(merged(rows, shared, "key").select("key", "node").distinct())
    if members.isEmpty():
        return None
    wanted = members.select("node").distinct()
    sets = cut(full_sets(merged(nodes(docs), wanted, "node", "left_semi")))
    sketches = cut(merged(sig, wanted, "node", "left_semi").select("node", *SKETCH_COLS))
    label, tried, turn = None, None, 0
    while True:
        met = cut(hub_pairs(with_components(members, label), sketches, tried, turn))
        tidy(spark)
        new = cut(confirm(met, sets, percent))
        n_met, n_new = met.count(), new.count()
        if n_new:
            label = components(with_links(label, new))
        if n_new <= WORTH * n_met:
            break
        tried = met if tried is None else cut(tried.union(met))
        turn += 1
    labelled = with_components(members, label)
    several = labelled.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).filter("p < q").select("key", "n")
    rest = cut(merged(merged(labelled, several, "key"), sketches, "node"))
    tidy(spark)
    left, right = rest.filter(F.col("n") <= FEW).alias("l"), rest.filter(F.col("n") <= FEW).alias("r")
    near = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") != F.col("r.component")) & (bits_apart("l", "r") <= MOST_BITS)
    few = merged(left, right, near, "left_semi").select("key", "node", "component")
    large = rest.filter(F.col("n") > FEW).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    active = cut(few.union(able_in_blocks(large)))
    tidy(spark)
    new = cut(confirm_blocks(active, sets, percent))
    if new.isEmpty():
        return label
    return components(with_links(label, new))


def with_component(own: DataFrame, label: DataFrame | None) -> DataFrame:
    """own (node, n_shingles, set_a, set_b) with the component of each row, by the labels (node, component) of classes that have links.

    Classes of many rows, HOT_CLASSES at most, are broadcast, and their rows, like
    those without shingles, are spread over all tasks: copies that a third of the
    rows are don't meet in one.
    """
    key = ["set_a", "set_b", "n_shingles"]
    classes = own.filter("n_shingles > 0").groupBy(*key).agg(F.min("node").alias("first"), F.count("*").alias("n"))
    if label is not None:
        classes = merged(classes, label.withColumnRenamed("node", "first"), "first", "left").withColumn("first", F.coalesce("component", "first")).drop("component")
    classes = cut(classes)
    least = F.col("n") > max(HOT_ROWS, own.count() // HOT_CLASSES)
    hot = classes.filter(least).select(*key, F.col("first").alias("hot"))
    alone = F.col("hot").isNotNull() | (F.col("n_shingles") == 0)
    met = own.join(F.broadcast(hot), key, "left").withColumn("spread", F.when(alone, F.xxhash64("node")).otherwise(F.col("set_a")))
    rest = classes.filter(~least).select(F.col("set_a").alias("spread"), "set_b", "n_shingles", "first")
    return met.join(rest, ["spread", "set_b", "n_shingles"], "left").select("node", "n_shingles", F.coalesce("hot", "first", "node").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    sig = cut(signatures(docs))
    out = with_component(sig.select("node", "n_shingles", "set_a", "set_b"), links(docs, sig, percent))
    null = lambda c: F.when(c != LAST_ID, c)
    return out.select(null(F.col("node")).alias("doc_id"), "n_shingles", null(F.col("component")).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs, all columns, with one document of each component; rows that share a doc_id stay or go together."""
    name = unused(docs, "gone")
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias(name)).distinct()
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.join(gone, node == F.col(name), "left_anti")


def oracle() -> str:
    """near_duplicates() over documents in DuckDB, by a join on every shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM w WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS k FROM s),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 75 * (m.n + o.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"""
