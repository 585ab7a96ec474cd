"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The trees and the lexicon are learned in one task from a bounded sample of
labelled rows: at most FIT_ROWS of each label and FIT_BYTES of text, those of least
hash of doc_id, weighted back to the label's share.  Every fourth sampled row is held back for
the calibration.  The lexicon holds words and word beginnings with their log
odds; other features are densities of second persons, hits near them, capitals,
punctuation, and words that spell letters by other signs (undone before the
lexicon is asked).  All documents are then scored in one pass over whole texts.

Rows: null and empty texts get the score of their features, as any other text.
Rows with a null doc_id are not held out and are never learned from.  Equal
texts get equal scores.  Labels that are null are left out; of a doc_id that is
labelled several times each label counts.  With no label of one kind the score
is the constant share of the other.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolith.llm.boosting import Boosted, isotonic
from regiolith.llm.common import lean, prepare

#: Rows of each label, and bytes of both, that the model is fitted on.
FIT_ROWS, FIT_BYTES = 6000, 64 << 20
MAX_WORDS = 400_000
LEXICON = 4000
PREFIXES = (4, 5, 6, 7, 8)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡“”„…"
# Second persons of the four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tú tus su".split())
# Signs that stand for letters.
LEET = str.maketrans("013457@$!|+€", "oieastasilte")

FEATURES = ["mean", "top", "second_top", "third_top", "over_1", "over_2", "over_3", "undone", "mixed", "second", "near", "capitals", "punctuation", "exclaim", "length", "hits"]


def grams(core: str) -> list[str]:
    """The lexicon's keys of a word: itself, and its beginnings marked by a star."""
    return [core, *[core[:k] + "*" for k in PREFIXES if k < len(core)]]


class Words(dict):
    """Packed facts about each raw word, found when first asked for: weight, weight after undoing signs, flags."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def weight(self, core: str) -> int:
        return int(max(0.0, min(7.9, max((self.lexicon.get(g, 0.0) for g in grams(core)), default=0.0))) * 16)

    def __missing__(self, raw: str) -> int:
        core = raw.strip(PUNCTUATION).lower()
        mixed = bool(core) and not core.isalpha() and any(c.isalpha() for c in core)
        known = self.weight(core) if core else 0
        undone = 0
        if mixed:
            plain = core.translate(LEET)
            undone = max(self.weight(plain), self.weight("".join(c for c in plain if c.isalpha())))
        out = known | undone << 7 | mixed << 14 | (core in SECOND) << 15 | (len(raw) > 1 and raw.isupper()) << 16 | min(15, sum(c in PUNCTUATION for c in raw)) << 17 | ("!" in raw) << 21
        if len(self) >= MAX_WORDS:
            self.clear()
        self[raw] = out
        return out


def features(texts: list[str], words: Words) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        split = text.split()
        n = len(split)
        if not n:
            continue
        x = np.fromiter(map(words.__getitem__, split), np.int64, n)
        undone = x >> 7 & 127
        w = np.maximum(x & 127, undone) / 16
        hit, second = w > 2, (x >> 15 & 1).astype(bool)
        near = 0
        if hit.any() and second.any():
            close = np.convolve(second, np.ones(7), "same") > 0 if n >= 7 else np.ones(n, bool)
            near = (hit & close).sum()
        top = np.sort(np.partition(w, n - 3)[-3:] if n > 3 else np.append(np.zeros(3), w)[-3:])
        punct = (x >> 17 & 15).sum()
        out[i] = w.mean(), top[2], top[1], top[0], (w > 1).mean(), hit.mean(), (w > 3).mean(), (undone > 32).sum(), (x >> 14 & 1).mean(), second.mean(), near / n, (x >> 16 & 1).mean(), punct / n, (x >> 21 & 1).mean(), np.log1p(n), hit.sum()
    return out


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Log odds of words and beginnings by how many texts of either kind hold them; only those that speak for toxic."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        cores = {w.strip(PUNCTUATION).lower() for w in text.split()}
        seen[int(y)].update({g for c in cores if c for g in grams(c)})
    n = [max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))]
    odds = {}
    for g, c in seen[1].items():
        if c >= max(3, 0.002 * n[1]):
            v = float(np.log((c + 0.5) / (n[1] + 1)) - np.log((seen[0][g] + 0.5) / (n[0] + 1)))
            if v > 1:
                odds[g] = v * min(1.0, 0.4 + c / (0.05 * n[1]))
    return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple:
    """(lexicon, trees, knots of the calibration); rows come in the order of their hash."""
    if len(set(toxic.tolist())) < 2:
        share = float(toxic[0]) if len(toxic) else 0.0
        return {}, None, (np.zeros(1), np.full(1, share))
    back = np.arange(len(texts)) % 4 == 3
    if len(set(toxic[back].tolist())) < 2 or len(set(toxic[~back].tolist())) < 2:
        back[:] = False
    own = [t for t, b in zip(texts, back) if not b]
    # the trees see features of a lexicon that did not see their rows: each half's from the other half
    half = np.arange(len(own)) % 2 == 1
    y, w = toxic[~back], weight[~back]
    x = np.zeros((len(own), len(FEATURES)))
    for a in (half, ~half):
        lexicon = learn_lexicon([t for t, b in zip(own, a) if not b], y[~a])
        x[a] = features([t for t, b in zip(own, a) if b], Words(lexicon))
    lexicon = learn_lexicon(own, y)
    trees = Boosted.fit(x, y, w)
    rest = back if back.any() else ~back
    raw = trees.raw(features([t for t, b in zip(texts, rest) if b], Words(lexicon)))
    return lexicon, trees, isotonic(raw, toxic[rest].astype(float), weight[rest])


def fit_model(docs: DataFrame, labels: DataFrame) -> bytes:
    """The model, pickled, learned in one task from a bounded sample."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = None
    for y, n in sorted(total.items()):
        part = known.filter(F.col("toxic") == y).withColumn("order", F.xxhash64(F.lit(7), "doc_id")).orderBy("order", "doc_id").limit(FIT_ROWS).withColumn("weight", F.lit(max(1.0, n / FIT_ROWS)))
        pick = part if pick is None else pick.union(part)
    if pick is None:
        return pickle.dumps(fit([], np.zeros(0, int), np.zeros(0)))
    # at most 2 * FIT_ROWS rows; of a doc_id that stands on several rows one text is learned
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "order", "toxic", "weight").agg(F.min("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    pick = sizes.withColumn("so_far", so_far).filter((F.col("so_far") <= FIT_BYTES // 2) | (F.col("so_far") == F.col("size"))).drop("so_far")
    met = texts.join(F.broadcast(pick), "doc_id").filter(F.octet_length("text") == F.col("size"))
    sample = met.groupBy("doc_id", "order", "toxic", "weight").agg(F.min("text").alias("text")).select("order", "toxic", "weight", "text")

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("text", "ascending")])
        model = fit(group["text"].to_pylist(), group["toxic"].to_numpy(), group["weight"].to_numpy())
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else pickle.dumps(fit([], np.zeros(0, int), np.zeros(0)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: doc_id, toxic."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels))  # LEXICON words and a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees, (knots, shares) = pickle.loads(shared.value)
        words = Words(lexicon)
        for b in batches:
            x = features([t or "" for t in b["text"].to_pylist()], words)
            s = np.interp(trees.raw(x) if trees else np.zeros(len(x)), knots, shares)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.clip(s, 0, 1))], ["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
