"""Substring dedup by suffix arrays over bytes, built a block at a time with a difference cover.

Suffixes that can start a repeated window (see ``repeats``) come in blocks of
memory size.  The cover of a text are its places of residues COVER modulo PERIOD,
counted from the text's start, so suffixes that are compared stand at any
differences of residues.  In a block the suffixes at cover places are ranked
beforehand, from right to left: each by its next PERIOD bytes and the rank of
the cover suffix after them.  Then one bucket of suffixes (those of one distance
from the bytes that they elect) is sorted at a time.  Suffixes of one residue are
in order by their next PERIOD bytes and the rank at their next cover place; the
runs of different residues are merged by bisection, where a tie of PERIOD bytes
is resolved by the ranks at the distance, less than PERIOD, at which both
suffixes stand at cover places.  So a tie of any length takes one comparison, and
memory is a few numbers a suffix.  Neighbours in the sorted bucket that agree on
a whole window repeat each other; of each run, the earliest one stays.

Rows: a null text is empty.  Texts shorter than the window lose nothing.  Of
equal texts the one of the smallest doc_id is the earliest, and the others lose
all bytes if they have a window's length; rows that repeat both doc_id and text
are one document, and each gets its result.  Rows with a null doc_id count as
one document for each text, after all others.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import prepare
from regiolith.llm.repeats import LAST_ID, Windows, content_key, covered, remove_repeats, safe_salt

LENGTH = 100
GRAM = 40
# Every difference modulo 7 is one of two members of this set.
PERIOD, COVER = 7, (0, 1, 3)
#: By two residues, the least distance at which both are in the cover; by one, the least at which it is.
BOTH = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])
ONE = np.diagonal(BOTH)
COVERED = np.isin(np.arange(PERIOD), COVER)


def head(around: np.ndarray, c: int) -> np.ndarray:
    """PERIOD bytes from column c on as one number, in their order."""
    wide = np.zeros((len(around), 8), np.uint8)
    have = around[:, c : c + PERIOD]
    wide[:, : have.shape[1]] = have
    return wide.view(">u8").ravel().astype(np.uint64)


def ranked(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """1 and up by place in order, equal for equal keys."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(around: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By column and row the rank of the cover suffix there among those of its column; 0 where the place is not in the cover, or the row has ended."""
    n, cols = around.shape
    ranks = np.zeros((cols + PERIOD, n), np.int32)
    for c in range(cols - 1, -1, -1):
        row = np.flatnonzero(COVERED[(at + c) % PERIOD])
        now, rest = head(around[row, c : c + PERIOD], 0), ranks[c + PERIOD, row]
        ranks[c, row] = ranked(np.lexsort((rest, now)), now, rest)
    return ranks


def sorted_bucket(row: np.ndarray, c: int, first: np.ndarray, residue: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rows of a bucket by their suffixes from column c on; first: the order of their groups and first PERIOD bytes."""
    cover = COVERED[residue]
    out = np.flatnonzero(cover)
    out = out[np.lexsort((ranks[c, row[out]], first[out]))]
    for r in np.unique(residue[~cover]).tolist():
        run = np.flatnonzero(residue == r)
        run = run[np.lexsort((ranks[c + ONE[r], row[run]], first[run]))]
        lo, hi = np.zeros(len(run), np.int64), np.full(len(run), len(out))
        while len(out) and (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(out) - 1)
            other = out[mid]
            step = c + BOTH[residue[other], r]
            less = (first[other] < first[run]) | (first[other] == first[run]) & (ranks[step, row[other]] < ranks[step, row[run]])
            todo = lo < hi
            lo, hi = np.where(todo & less, mid + 1, lo), np.where(todo & ~less, mid, hi)
        out = np.insert(out, lo, run)
    return row[out]


def repeats_in_block(w: Windows, group: np.ndarray, turn: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which windows also stand earlier; columns are window starts from left to right, turn is the order of the anchors."""
    ranks = cover_ranks(around, at)
    gone = np.zeros((len(group), w.width), bool)
    for c in range(w.width):
        offset = w.width - 1 - c
        row = np.flatnonzero((first <= offset) & (offset <= last))
        if len(row) < 2:
            continue
        own, now = group[row], head(around[row, c : c + PERIOD], 0)
        order = sorted_bucket(row, c, ranked(np.lexsort((now, own)), own, now), (at[row] + c) % PERIOD, ranks)
        same = np.ones(len(order) - 1, bool)
        for x in range(0, len(same), 50_000):
            y = order[x : x + 50_001]
            same[x : x + 50_000] = (group[y[1:]] == group[y[:-1]]) & (around[y[1:], c : c + w.length] == around[y[:-1], c : c + w.length]).all(axis=1)
        start = np.flatnonzero(np.append(True, ~same))
        earliest = np.minimum.reduceat(turn[order], start)
        run = np.cumsum(np.append(True, ~same)) - 1
        gone[order, c] = turn[order] != earliest[run]
    return gone


WINDOWS = Windows("byte", LENGTH, GRAM, first_stays=True, block=repeats_in_block)


def _finish(text: bytes, spans: np.ndarray) -> tuple[int, int, int, str, list[int]]:
    if not len(spans):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), []
    gone = covered(len(text), spans)
    kept = np.frombuffer(text, np.uint8)[~gone]
    edge = np.diff(np.pad(gone, 1).astype(np.int8))
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
    return len(text), int(gone.sum()), len(runs), hashlib.sha256(kept.tobytes()).hexdigest(), runs.ravel().tolist()


def repeated_bytes(docs: DataFrame, w: Windows = WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and runs (start, end, start, ... of the bytes removed) of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    salt = safe_salt(docs)
    found = remove_repeats(docs, w, salt, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<long>")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(salt).alias("content"))
    copy = (F.coalesce("doc_id", F.lit(LAST_ID)) > F.col("first_id")) & (F.col("n_bytes") >= w.length)
    either = lambda a, c: F.when(copy, a).otherwise(F.col(c)).alias(c)
    return own.join(found, "content").select(
        "doc_id",
        "n_bytes",
        either(F.col("n_bytes"), "n_removed"),
        either(F.lit(1).cast("long"), "n_spans"),
        either(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256"),
        either(F.array(F.lit(0).cast("long"), F.col("n_bytes")), "runs"),
    )


def oracle() -> str:
    """repeated_bytes() over documents in DuckDB, by every window's hexadecimal digits; for a table whose doc_ids are distinct."""
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS turn FROM x) WHERE turn > 1),
e AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {LENGTH}, -1) AS new FROM r),
n AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY ALL),
g AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda j: substr(h, CAST(CASE WHEN j = 0 THEN 0 ELSE ends[j] END AS BIGINT) * 2 + 1, CAST((CASE WHEN j = len(starts) THEN len(h) // 2 ELSE starts[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) AS BIGINT) * 2)), '') END)) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
