"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes of the corpus that can start a repeated window (see ``repeats``) are
partitioned by prefixes of variable length: the GRAM words that their windows
elect, or, where more suffixes share these than fit a group of the stated size,
all words of the window.  Within a group the tree of its suffixes is grown
write-only and top down: the leaves below an open node are split by their next
word; a node that splits is written with its depth and parent, children with two
leaves or more stay open, and words that do not split lengthen an edge.  A tree
ends at the window's length; the internal nodes at that depth are the deep ones,
and the leaves below them are the starts of repeats of at least that many words.

Rows: a null text has no words.  Texts of fewer words than the window lose
nothing.  Equal texts of different documents are copies, which lose all words if
they have a window's length; rows that repeat both doc_id and text are one
document, and each gets its result.  Rows with a null doc_id count as one
document for each text, another one than any with a doc_id.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import prepare, unused, word_spans
from regiolith.llm.repeats import Windows, content_key, covered, remove_repeats, safe_salt

LENGTH = 35
GRAM = 12


@dataclass(frozen=True)
class Tree:
    """The internal nodes of some suffix trees, and the node that each leaf hangs from (-1: from none)."""

    depth: np.ndarray
    parent: np.ndarray
    node: np.ndarray

    @classmethod
    def grow(cls, words: np.ndarray, root: np.ndarray, depths: Iterable[int], length: int) -> Tree:
        """Trees of the suffixes in the rows of words, one for each value of root; only the columns in depths can split."""
        node = np.full(len(words), -1)
        depth, parent, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        leaf = np.argsort(root, kind="stable")
        open_ = np.cumsum(np.append(False, np.diff(root[leaf]) != 0))
        above = np.full(open_[-1] + 1 if len(leaf) else 0, -1)  # the written node over each open one
        for d in [*depths, length]:
            if not len(leaf):
                break
            branch = open_ << 32 | words[leaf, d] if d < length else open_
            order = np.argsort(branch, kind="stable")
            leaf, open_, branch = leaf[order], open_[order], branch[order]
            first = np.append(True, branch[1:] != branch[:-1])
            child = np.cumsum(first) - 1
            size, under = np.bincount(child), open_[first]
            written = np.flatnonzero((np.bincount(under, minlength=len(above)) > 1) | (d == length) & (np.bincount(open_, minlength=len(above)) > 1))
            depth.append(np.full(len(written), d))
            parent.append(above[written])
            above = above.copy()
            above[written] = n + np.arange(len(written))
            n += len(written)
            keep = (size > 1)[child] & (d < length)
            node[leaf[~keep]] = above[open_[~keep]]
            above = above[under[size > 1]]
            leaf, open_ = leaf[keep], (np.cumsum(size > 1) - 1)[child[keep]]
        return cls(np.concatenate(depth), np.concatenate(parent), node)


def deep_leaves(w: Windows, group: np.ndarray, turn: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which windows are leaves of a node at depth w.length; columns are window starts from left to right."""
    _, name = np.unique(around, return_inverse=True)
    name = name.reshape(around.shape).astype(np.int64)
    gone = np.zeros((len(group), w.width), bool)
    for c in range(w.width):
        offset = w.width - 1 - c
        leaf = np.flatnonzero((first <= offset) & (offset <= last))
        depths = [d for d in range(w.length) if not offset <= d < offset + w.gram]  # equal within a group already
        tree = Tree.grow(name[leaf, c : c + w.length], group[leaf], depths, w.length)
        below = tree.node >= 0
        gone[leaf[below], c] = tree.depth[tree.node[below]] == w.length
    return gone


WINDOWS = Windows("word", LENGTH, GRAM, first_stays=False, block=deep_leaves)


def _finish(text: bytes, spans: np.ndarray) -> tuple[int, int, str, str | None]:
    words = text.split()
    if not len(spans):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), None
    gone = covered(len(words), spans)
    kept = [x for x, g in zip(words, gone.tolist()) if not g]
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), cut_text(text, gone)


def cut_text(text: bytes, gone: np.ndarray) -> str:
    """The text without the words of gone; white space between two kept words stays, one space stands for each run removed."""
    data = np.frombuffer(text, np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    edge = np.flatnonzero(np.diff(kept) > 1)
    runs = zip(np.append(kept[0], kept[edge + 1]), np.append(kept[edge], kept[-1]))
    return b" ".join(text[s[i] : e[j]] for i, j in runs).decode()


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def dedup_texts(docs: DataFrame, w: Windows, salt: int) -> DataFrame:
    """content, n_words, n_removed, kept_sha256, kept (the text left; null: as it was) of every distinct text."""
    out = remove_repeats(docs, w, salt, _finish, "n_words long, n_removed long, kept_sha256 string, kept string")
    copied = (F.col("first_id") < F.col("last_id")) & (F.col("n_words") >= w.length)
    return out.select(
        "content",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copied, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def repeated_words(docs: DataFrame, w: Windows = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    salt = safe_salt(docs)
    found = dedup_texts(docs, w, salt).drop("kept")
    return docs.select("doc_id", content_key(salt).alias("content")).join(found, "content").select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, w: Windows = WINDOWS) -> DataFrame:
    """docs, all columns, each text without the words of its repeated windows; n_chars, if there, follows the text."""
    prepare(docs.sparkSession)
    salt, key, content, kept = safe_salt(docs), *(unused(docs, x) for x in ("key_of_text", "content_found", "kept_text"))
    found = dedup_texts(docs, w, salt).filter("n_removed > 0").select(F.col("content").alias(content), F.col("kept").alias(kept))
    joined = docs.withColumn(key, content_key(salt)).join(found, F.col(key) == F.col(content), "left")
    length = F.when(F.col(kept).isNotNull(), F.char_length(kept))
    new = {"text": F.coalesce(kept, "text"), "n_chars": F.coalesce(length.cast("long"), "n_chars") if "n_chars" in docs.columns else None}
    return joined.select(*[new[c].cast(t).alias(c) if c in new else F.col(f"`{c}`") for c, t in docs.dtypes])


def oracle() -> str:
    """repeated_words() over documents in DuckDB, by counting every window's words."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM w WHERE len(w) >= {LENGTH}),
x AS (SELECT doc_id, i, array_to_string(w[i : i + {LENGTH - 1}], ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, {LENGTH})) AS j)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(g.ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g.ps IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(g.ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""
