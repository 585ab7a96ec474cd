"""Quality rules: counts of each text, and perplexity bands by language.

The language model is an interpolated modified Kneser-Ney model of order 4 over
bytes, one for each language.  It learns from the documents that look like prose:
LEAST_WORDS words or more, and at most one character in SYMBOL_SHARE a symbol.
Spark counts the 4-grams of all of them by a partial and a final sum, and
everything else follows from those counts, none left out.  A model is sorted
arrays, searched by bisection: the codes of each order next to their log
probabilities, and the contexts of each order next to the log of what they leave
to the order below.  A language has a model of its own from LEAST_DOCS documents
on; with more than MOST_MODELS such languages the smaller ones, like those under
LEAST_DOCS, share one, so what is broadcast is bounded by MOST_MODELS models.

A document is rejected when the log perplexity of its bytes leaves its language's
band, [q1 - BELOW * s, q3 + ABOVE * s], with the quartiles q1 and q3 of the
language's documents of at least LEAST_WORDS words and their distance s, taken as
LEAST_SPREAD at least; base rules reject as well.

Rows: a null text is empty, has no words and fails the base rules.  A null or
rare lang falls to the shared model.  Equal rows get equal results; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from regiolith.llm.common import WHITE, cut, flat, lean, prepare, slices, unused, word_spans

LEAST_DOCS, MOST_MODELS = 200, 64
BELOW, ABOVE, LEAST_SPREAD = 4.0, 4.0, 0.03
ORDER, SYMBOL_SHARE = 4, 200
LEAST_WORDS = 50
REST = "*"
#: Bytes of text measured at once.
SLICE = 1 << 19
SYMBOLS = b"#*$%&|<>"


SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four bytes that end at each byte as one number; before a document stand three zeros."""
    n, lens = len(data), np.diff(offsets)
    at = np.arange(n) + np.repeat(3 * np.arange(1, len(lens) + 1), lens)
    c = np.zeros(n + 3 * len(lens), np.uint32)
    c[at] = data
    return c[at - 3] << 24 | c[at - 2] << 16 | c[at - 1] << 8 | c[at]


def sums_by_text(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[offsets])


def code_points(part: np.ndarray) -> np.ndarray:
    return part & 0xC0 != 0x80


def prose(part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the model learns from."""
    words = np.diff(word_spans(part, offsets)[2])
    return (words >= LEAST_WORDS) & (SYMBOL_SHARE * sums_by_text(SYMBOL[part], offsets) <= sums_by_text(code_points(part), offsets))


def count_grams(docs: DataFrame) -> DataFrame:
    """(model, gram, n) of docs (model, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)

        for b in batches:
            model = np.array([names.setdefault(m, len(names)) for m in b["model"].to_pylist()], np.uint64)
            data, offsets = flat(b["text"])
            for lo, hi in slices(offsets, SLICE):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lens = np.diff(off)
                own = np.repeat(prose(part, off), lens)
                held.append(np.unique((np.repeat(model[lo:hi] << np.uint64(32), lens) | codes(part, off))[own], return_counts=True))
            if sum(len(k) for k, _ in held) > 1_500_000:
                held = [merged()]
        if held:
            key, n = merged()
            label = list(names)
            for i in range(0, len(key), 100_000):
                k = key[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([label[m] for m in (k >> np.uint64(32)).tolist()], pa.string()), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[i : i + 100_000])], ["model", "gram", "n"])

    return docs.select("model", "text").mapInArrow(lean(run), "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discount of each count, from how many counts are 1, 2, 3 and 4."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 * i for i in (1, 2, 3)]
    return np.array(d)[np.minimum(counts, 3)]


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted code is in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """P(byte | three before).  By order, the codes seen and their logs, and the contexts seen and the logs of what they leave."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels

    @classmethod
    def fit(cls, gram: np.ndarray, n: np.ndarray) -> Model:
        order = np.argsort(gram)
        kinds = [(gram[order].astype(np.uint32), n[order])]
        for k in range(ORDER - 1, 0, -1):  # each lower order counts the different bytes before
            kinds.insert(0, np.unique(kinds[0][0] & np.uint32((1 << 8 * k) - 1), return_counts=True))
        model = cls([])
        for codes_, count in kinds:
            context, at = np.unique(codes_ >> np.uint32(8), return_inverse=True)
            off = discounts(count)
            total = np.bincount(at, count)
            lower = np.exp(model.log(codes_))
            high = np.maximum(count - off, 0) / total[at]
            left = np.bincount(at, off) / total
            model.levels.append((codes_, np.log(high + left[at] * lower), context, np.log(left)))
        return cls([(k, p.astype(np.float32), c, w.astype(np.float32)) for k, p, c, w in model.levels])

    def log(self, gram: np.ndarray) -> np.ndarray:
        """Logs by the orders that the model has, from a uniform byte up."""
        out = np.full(len(gram), -np.log(256.0))
        for k, (keys, logs, contexts, weights) in enumerate(self.levels, 1):
            own = gram & np.uint32((1 << 8 * k) - 1 & 0xFFFFFFFF)
            at, seen = found_in(keys, own)
            up, known = found_in(contexts, own >> np.uint32(8))
            if len(keys):
                out = np.where(seen, logs[at], np.where(known, weights[up] + out, out))
        return out

    def pack(self) -> list[bytes]:
        return [x.tobytes() for level in self.levels for x in level]

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Model:
        kinds = (np.uint32, np.float32, np.uint32, np.float32)
        arrays = [np.frombuffer(b, kinds[i % 4]) for i, b in enumerate(blobs)]
        return cls([tuple(arrays[i : i + 4]) for i in range(0, len(arrays), 4)])


def fit_models(docs: DataFrame) -> dict[str, list[bytes]]:
    """A packed model for each value of docs.model, which are MOST_MODELS + 1 at most; a value without prose has none."""

    def build(group: pa.Table) -> pa.Table:
        m = Model.fit(group["gram"].to_numpy().astype(np.uint32), group["n"].to_numpy())
        return pa.table({"model": [group["model"][0].as_py()], "blobs": [m.pack()]}, pa.schema([("model", pa.string()), ("blobs", pa.list_(pa.binary()))]))

    rows = count_grams(docs).groupBy("model").applyInArrow(build, "model string, blobs array<binary>").collect()
    return {r["model"]: [bytes(x) for x in r["blobs"]] for r in rows}


def with_model(docs: DataFrame, name: str = "model") -> DataFrame:
    """docs with the name of the model that scores each row: its language, or REST for small ones."""
    n = docs.filter("lang IS NOT NULL").groupBy("lang").count().filter(F.col("count") >= LEAST_DOCS)
    own = [r["lang"] for r in n.orderBy(F.desc("count"), "lang").limit(MOST_MODELS).collect()]
    return docs.withColumn(name, F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit(REST)) if own else F.lit(REST))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    three = list(zip(words, words[1:], words[2:]))
    if len(set(three)) == len(three):
        return 0
    n, total, end = Counter(three), 0, 0
    for i, x in enumerate(three):
        if n[x] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def repeat_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "log_ppl": "double"}


class Meter:
    """Measures texts under given models."""

    def __init__(self, packed: dict[str, list[bytes]]) -> None:
        self.models = {k: Model.unpack(m) for k, m in packed.items()}

    def __call__(self, text: pa.Array, model: pa.Array) -> list[np.ndarray]:
        """The columns of MEASURES."""
        data, offsets = flat(text)
        label = np.array(model.to_pylist(), object)
        out: list[list[np.ndarray]] = []
        for lo, hi in slices(offsets, SLICE):
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            grams, lens, score = codes(part, off), np.diff(off), np.zeros(len(part))
            for name in set(label[lo:hi]):
                own = np.repeat(label[lo:hi] == name, lens)
                if own.any():
                    seen, at = np.unique(grams[own], return_inverse=True)
                    score[own] = self.models.get(name, Model([])).log(seen)[at]
            total = np.diff(np.append(0.0, np.cumsum(score))[off])
            texts = [part[i:j].tobytes() for i, j in zip(off[:-1], off[1:])]
            repeats = (np.array([f(t) for t in texts], np.int64) for f in (repeat_lines, lambda t: repeat_words(t.split())))
            words = np.diff(word_spans(part, off)[2])
            out.append([words, sums_by_text(~WHITE[part] & code_points(part), off), sums_by_text(SYMBOL[part], off), *repeats, -total / np.maximum(lens, 1)])
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]


def measure(docs: DataFrame, models: dict[str, list[bytes]]) -> DataFrame:
    """doc_id, model and MEASURES of docs (doc_id, model, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["model"], *map(pa.array, meter(b["text"], b["model"]))], ["doc_id", "model", *MEASURES])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "model", "text")
    return rows.mapInArrow(lean(run), "doc_id long, model string, " + ", ".join(f"{c} {t}" for c, t in MEASURES.items()))


def bands(seen: DataFrame) -> DataFrame:
    """(model, low, high): the bands of log perplexity, from the quartiles of measured documents."""
    # by thousandths, of which there are few, so that quartiles are exact and do not depend on the order of rows
    n = seen.filter(F.col("n_words") >= LEAST_WORDS).groupBy("model", F.round("log_ppl", 3).alias("bin")).agg(F.count("*").alias("n"))
    band = n.groupBy("model").agg(F.percentile("bin", [0.25, 0.75], F.col("n")).alias("q"))
    spread = F.greatest(F.get("q", F.lit(1)) - F.get("q", F.lit(0)), F.lit(LEAST_SPREAD))
    return band.select("model", (F.get("q", F.lit(0)) - BELOW * spread).alias("low"), (F.get("q", F.lit(1)) + ABOVE * spread).alias("high"))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame) -> DataFrame:
    """The verdict on every row of docs (doc_id, text, lang).

    Returns a row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, perplexity, and the band's
    ends, band_low and band_high (perplexities of the row's language).
    """
    prepare(docs.sparkSession)
    named = with_model(docs.select("doc_id", "text", "lang"))
    seen = cut(measure(named, fit_models(named)))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    # at most MOST_MODELS + 1 bands
    return seen.join(F.broadcast(bands(seen)), "model", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("band_low"), F.exp("high").alias("band_high")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) that judge() keeps, all columns.

    Texts are measured once: rows and what was measured of them are written to the
    shared folder, and the bands, and then the verdicts, follow from that.
    """
    spark = prepare(docs.sparkSession)
    model, words, repeats, ppl = (unused(docs, x) for x in ("model_of_row", "words_of_row", "repeats_of_row", "ppl_of_row"))
    named = with_model(docs, model)
    shared = spark.sparkContext.broadcast(fit_models(named.select(F.col(model).alias("model"), "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shared.value)
        for b in batches:
            n_words, _, _, _, n_repeat, log_ppl = meter(b["text"], b[model])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words), pa.array(n_repeat), pa.array(log_ppl)], [*b.schema.names, words, repeats, ppl])

    schema = StructType([*named.schema.fields, StructField(words, LongType()), StructField(repeats, LongType()), StructField(ppl, DoubleType())])
    seen = cut(named.mapInArrow(lean(run), schema))
    band = bands(seen.select(F.col(model).alias("model"), F.col(words).alias("n_words"), F.col(ppl).alias("log_ppl")))
    low, high = unused(docs, "low_of_band"), unused(docs, "high_of_band")
    met = seen.join(F.broadcast(band.select(F.col("model").alias(model), F.col("low").alias(low), F.col("high").alias(high))), model, "left")
    inside = F.coalesce(F.col(ppl).between(F.col(low), F.col(high)), F.lit(True))
    return met.filter(~base_failed(F.col(words), F.col(repeats)) & inside).select(*[F.col(f"`{c}`") for c in docs.columns])
