"""The operators against plain versions on a small corpus with every odd case, and on odd tables."""

import dataclasses
import hashlib
import html
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regiolith.llm import backoff, boosting, byte_bpe, decontaminate, html_blocks, html_extract, license_scan, minhash, quality, repeats, suffix_array, suffix_tree, toxicity
from tests.llm import brute


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def plain(corpus):
    return [(d, t) for d, t, *_ in corpus]


# ------------------------------------------------------------ 1


def test_license_scan(docs, corpus):
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert len(got) == len(corpus)
    for d, t in plain(corpus):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [i for p in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (got[d]["n_words"], got[d]["n_base"], got[d]["first_word"], got[d]["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        want = license_labels(words)
        assert set(got[d]["labels"].split(",")) - {""} == want | (set(got[d]["base_labels"].split(",")) - {""})
        assert 0 <= got[d]["score"] <= 1


def license_labels(words):
    """The labels of all templates of which some run of words, long enough, holds enough."""
    found = set()
    for label, t in license_scan.TEMPLATES.items():
        own, long = set(t.split()), license_scan.block_length(t)
        if any(len(own & set(words[i : i + long])) >= license_scan.needed(t, license_scan.THRESHOLD) for i in range(len(words))):
            found.add(label)
    return found


def test_wrapped_and_scattered_notices(spark):
    bsd = license_scan.TEMPLATES["bsd"].split()
    wrapped = "# " + "\n# ".join(" ".join(bsd[i : i + 6]) for i in range(0, len(bsd), 6))
    scattered = " ".join(f"{w} filler filler filler filler" for w in bsd)
    spaced = " ".join([*bsd[:10], "and", "also", *bsd[10:]])
    short = " ".join(bsd[: len(bsd) // 2])
    rows = spark.createDataFrame(list(enumerate([wrapped, scattered, spaced, short, wrapped.upper() * 3, "mit " * 5000])), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(rows).collect()}
    assert got == {0: "bsd", 1: "", 2: "bsd", 3: "", 4: "bsd", 5: ""}


# ------------------------------------------------------------ 2 and 4


def test_repeated_words(docs, corpus):
    assert by_id(suffix_tree.repeated_words(docs)) == brute.repeated_words(plain(corpus))


def test_repeated_bytes(docs, corpus):
    got = {k: v[:4] for k, v in by_id(suffix_array.repeated_bytes(docs)).items()}
    assert got == brute.repeated_bytes(plain(corpus))


@pytest.mark.parametrize("name", ["tree", "array"])
def test_hot_anchors_take_longer_prefixes(docs, corpus, name, monkeypatch):
    """With groups of two rows every repeated anchor is hot, and with fewer keys allowed only the most frequent are."""
    module, function, plainly = {"tree": (suffix_tree, suffix_tree.repeated_words, brute.repeated_words), "array": (suffix_array, suffix_array.repeated_bytes, brute.repeated_bytes)}[name]
    small = dataclasses.replace(module.WINDOWS, group_bytes=2 * module.WINDOWS.row_bytes)
    passage = corpus[0][1] if len((corpus[0][1] or "").split()) > 60 else " ".join(f"w{i % 37}" for i in range(80))
    rows = plain(corpus) + [(1000 + i, f"own{i} start {passage} then own{i} end") for i in range(30)]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(repeats.hot_anchors(frame, small)) > 3
    assert {k: v[: 3 if name == "tree" else 4] for k, v in by_id(function(frame, small)).items()} == plainly(rows)
    monkeypatch.setattr(repeats, "GROUP_KEYS", 40)
    assert {k: v[: 3 if name == "tree" else 4] for k, v in by_id(function(frame, small)).items()} == plainly(rows)


def test_null_ids_are_another_document(spark):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = spark.createDataFrame([(5, text), (None, text), (None, other), (None, other)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_tree.repeated_words(rows).collect()) == [0, 0, 50, 50]
    assert sorted((r["doc_id"] is None, r["n_removed"] > 0) for r in suffix_array.repeated_bytes(rows).collect()) == [(False, False), (True, False), (True, False), (True, True)]


def test_trees_are_suffix_trees():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, length = int(rng.integers(1, 30)), int(rng.integers(1, 7))
        words, root = rng.integers(0, 3, (n, length)), rng.integers(0, 2, n)
        tree = suffix_tree.Tree.grow(words, root, range(length), length)
        keys = [(int(root[i]), *words[i].tolist()) for i in range(n)]
        prefixes = {k[: d + 1]: [j for j in range(n) if keys[j][: d + 1] == k[: d + 1]] for k in keys for d in range(length + 1)}
        inner = {p for p, own in prefixes.items() if len(own) > 1 and (len(p) == length + 1 or len({keys[j][: len(p) + 1] for j in own}) > 1)}
        assert len(tree.depth) == len(inner) and sorted(tree.depth.tolist()) == sorted(len(p) - 1 for p in inner)
        for i, k in enumerate(keys):
            over = [d for d in range(length + 1) if k[: d + 1] in inner]
            assert (tree.depth[tree.node[i]] if tree.node[i] >= 0 else None) == max(over, default=None)
        assert all(p < 0 or tree.depth[p] < d for p, d in zip(tree.parent, tree.depth))


def test_buckets_are_sorted_by_cover_ranks():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n, cols = int(rng.integers(2, 60)), 40
        around, at = rng.choice([97, 98], (n, cols), p=[0.9, 0.1]).astype(np.uint8), rng.integers(0, 1000, n)
        ranks = suffix_array.cover_ranks(around, at)
        for c in (0, 5, 20):
            row = np.arange(n)
            now = suffix_array.head(around, c)
            order = suffix_array.sorted_bucket(row, c, suffix_array.ranked(np.argsort(now, kind="stable"), now), (at + c) % suffix_array.PERIOD, ranks)
            suffixes = [around[i, c:].tobytes() for i in order]
            assert suffixes == sorted(suffixes)


def test_cut_text_keeps_other_white_space(docs, corpus):
    out = {r["doc_id"]: r["text"] for r in suffix_tree.without_repeats(docs).collect()}
    want = brute.repeated_words(plain(corpus))
    assert len(out) == len(corpus)
    for d, t in plain(corpus):
        assert hashlib.sha256(b" ".join((out[d] or "").encode().split())).hexdigest() == want[d][2]
        if not want[d][1]:
            assert out[d] == t


# ------------------------------------------------------------ 3


def test_quality_counts(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for d, t in plain(corpus):
        t = t or ""
        w = t.encode().split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)} if len(w) < 2000 else None
        r = got[d]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if again is not None:
            assert r["n_repeat_words"] == len(again)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {d for d, r in got.items() if r["kept"]}


def test_kneser_ney_sums_to_one():
    data = np.frombuffer(b"the cat sat on the mat. the dog sat. " * 20 + b"xyzzy qq", np.uint8)
    gram, n = np.unique(quality.codes(data, np.array([0, len(data)])), return_counts=True)
    m = quality.Model.unpack(quality.Model.fit(gram, n).pack())
    for context in (0, int(gram[5] >> 8), int(gram[-1] >> 8), 0x7A7A7A):
        p = np.exp(m.log((context << 8 | np.arange(256)).astype(np.uint32)))
        assert abs(p.sum() - 1) < 1e-3


def test_verdicts_are_those_of_plain_models(spark, monkeypatch):
    """Kneser-Ney with dictionaries, quartiles with sorting, and two languages, one of them with a model of its own."""
    monkeypatch.setattr(quality, "LEAST_DOCS", 30)
    rng = random.Random(12)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60)] for lang, letters in (("en", "abcdefgh"), ("de", "mnopqrsü"), (None, "ijkl中"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(40, 90))), lang) for i, lang in enumerate(rng.choices(["en", "de", None], weights=[6, 2, 2], k=150))]
    rows += [(200 + i, " ".join(w + "%%%" for w in rng.choices(words["en"], k=70)), "en") for i in range(8)]
    rows += [(300 + i, " ".join(rng.choices(words["de"], k=70)), "en") for i in range(3)] + [(400, None, "en"), (401, "", None), (402, "word " * 80, "en")]
    want = brute.quality_verdicts(rows, 30)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["kept"], r["perplexity"]) for r in quality.judge(frame).collect()}
    assert all(abs(math.log(got[d][1]) - p) < 1e-4 for d, (_, p) in want.items())
    assert {d: k for d, (k, _) in got.items()} == {d: k for d, (k, _) in want.items()}
    assert not any(got[200 + i][0] for i in range(8))
    assert {r["doc_id"] for r in quality.keep_good(frame).collect()} == {d for d, (k, _) in want.items() if k}


def test_bands_tell_the_labels(spark):
    """On the tables: what the labels call good stays, what they call bad and the base rules let pass goes."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.05 * n[0, False] and n.get((1, False), 0) <= 0.03 * n[1, True]


# ------------------------------------------------------------ 5


def test_encoding_round_trip(docs, corpus):
    import public_tokenizers
    import tiktoken

    path, pattern = byte_bpe.defaults()
    assert pattern == public_tokenizers.PATTERN
    ranks = byte_bpe.BytePairs.load(path, pattern).ranks
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.round_trip(docs, with_ids=True, limits=(2000, 1000)))  # small tables start anew many times
    for d, t in plain(corpus):
        ids = real.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True, ids)


def test_streaming_decoder():
    b = byte_bpe.BytePairs.load(*byte_bpe.defaults())
    text = "naïve 中文 🙂 end"
    assert "".join(b.decode(b.encode(text))) == text
    for bad in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf5", b"\x80"):
        with pytest.raises(ValueError):
            byte_bpe.Utf8().feed(bad)
    machine = byte_bpe.Utf8()
    assert "".join(machine.feed(bytes([x])) for x in text.encode()) == text


# ------------------------------------------------------------ 6


def changed(rng, text, edits):
    out = bytearray(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        k = rng.random()
        if k < 0.34:
            del out[i]
        elif k < 0.67:
            out.insert(i, rng.choice(b"abcdef "))
        else:
            out[i] = rng.choice(b"abcdef ")
    return bytes(out)


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(30, 60))) for i in range(40)] + [(90, "two words"), (91, ""), (92, None)]
    docs, want = [], set()
    for k in range(300):
        i, t = items[k % 40]
        body = t
        if k % 3 == 1:
            body = changed(rng, t.upper().encode(), len(t) // 20).decode()
        holds = k % 3 != 2
        docs.append((k, f"{text(40)} {body if holds else text(40)}  \n{text(30)}"))
        if holds:
            want.add((k, i))
    docs += [(1000, None), (1001, ""), (1002, "here are two  words")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert len(want & got) >= 0.97 * len(want)
    assert got - want == {(1002, 90)}
    assert {k for k, _ in want if k % 3 == 0} <= {d for d, _ in got}  # exact ones are always found
    left = {r["doc_id"] for r in decontaminate.without_leaks(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_without_an_intact_word(spark):
    """A letter of every sixth changed: hardly a word of the item is left, and it is within MAX_EDITS."""
    rng = random.Random(18)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(5, 9))) for _ in range(500)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    docs = [(i, " ".join(rng.choices(words, k=40)) + " " + "".join("z" if k % 6 == 3 else c for k, c in enumerate(t)) + " tail") for i, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(20)}


def test_decontamination_with_wide_white_space(spark):
    rng = random.Random(19)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    item = rng.choices(words, k=40)
    docs = [(0, "x " + (" " * 60).join(item) + " y"), (1, "\n\n\t    ".join(item)), (2, " ".join(item[:20]) + " " * 3000 + " ".join(item[20:])), (3, (" " * 60).join(rng.choices(words, k=40)))]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {(0, 7, 0), (1, 7, 0), (2, 7, 0)}


def test_recall_at_every_edit_rate(spark):
    """Nine in ten copies at least are found at every rate of random edits up to MAX_EDITS, among texts of the tables."""
    rng = random.Random(21)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if r["text"]]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").dropna().collect()]
    rates, docs = (0.03, 0.08, 0.13, 0.17, 0.2), []
    for k, rate in enumerate(rates):
        for i, t in items:
            normal = decontaminate.normal(t.encode())
            body = changed(rng, normal, int(rate * len(normal))).decode("utf-8", "replace")
            docs.append((1000 * i + k, f"{rng.choice(texts)[:400]} {body} {rng.choice(texts)[:400]}"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, rate in enumerate(rates):
        near = [i for i, t in items for d, body in docs if d == 1000 * i + k and decontaminate.edit_distance(p := decontaminate.normal(t.encode()), decontaminate.normal(body.encode())) <= decontaminate.MAX_EDITS * len(p)]
        assert len(near) >= 0.6 * len(items) and sum((1000 * i + k, i) in found for i in near) >= 0.9 * len(near), rate


def test_edit_distance_is_exact():
    rng = random.Random(3)

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(200):
        p, t = (bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(2))
        assert decontaminate.edit_distance(p, t) == slow(p, t)


# ------------------------------------------------------------ 7


def test_toxicity_learns_and_calibrates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        w = rng.choices(words, k=rng.randint(10, 60))
        if toxic:
            for bad in rng.choices(["nastyword", "uglyterm", "n4stywo0rd"], k=3):
                w.insert(rng.randrange(len(w)), bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "nobody")]
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    assert {r["doc_id"] for r in got if r["held_out"]} == {d for d, _ in docs if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    none = toxicity.score(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r["score"] for r in none} == {0.0}


def test_isotonic_and_trees():
    x, y = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0.0, 0.5, 1.0] and (np.diff(x) > 0).all()
    rng = np.random.default_rng(1)
    f = rng.normal(size=(2000, 3))
    t = ((f[:, 0] > 0) ^ (f[:, 1] > 0)).astype(float)
    assert ((boosting.Boosted.fit(f[:1000], t[:1000], np.ones(1000)).raw(f[1000:]) > 0) == t[1000:]).mean() > 0.9


# ------------------------------------------------------------ 8


def test_html_blocks():
    page = "<title>no</title><p>a&amp;b <b>c\n d</b><br>e<p>f<script>var x='</p>';</script><ul><li>g<li>h</ul><div>i<p>j</p>k</div><!-- z --><table><tr><td>l<td>m</table>n < o"
    assert [b.text for b in html_blocks.blocks(page)] == ["a&b c d e", "f", "g", "h", "i", "j", "k", "l", "m", "n < o"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<") [0].text == "<"


def test_extraction_on_held_out_pages(spark):
    rng = random.Random(77)
    pages = [html_extract.labelled_page(rng) for _ in range(150)]
    rows = [(i, "u", p) for i, (p, _) in enumerate(pages)] + [(900, "u", None), (901, None, "")]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert np.mean([got[i]["text"] == "\n\n".join(a) for i, (_, a) in enumerate(pages)]) > 0.85
    assert got[900]["text"] == got[901]["text"] == "" and got[900]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_extraction_on_the_tables(spark):
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        want[r["page_id"]] = "\n\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(rows).collect()} == want


# ------------------------------------------------------------ 9


def test_near_duplicates(docs, corpus):
    want = brute.near_duplicates(plain(corpus))
    assert by_id(minhash.near_duplicates(docs)) == want
    assert {r["doc_id"] for r in minhash.without_near_duplicates(docs).collect()} == {d for d, v in want.items() if v[2]}


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    assert by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_duplicates(rows)


def test_large_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 3)
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(i, text("a")) for i in range(5, 20)] + [(i, text("a") + " tail") for i in range(2, 5)] + [(i, text("b")) for i in range(30, 33)] + [(i, None) for i in range(40, 50)] + [(60, text("c"))]
    assert by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute.near_duplicates(rows)


def test_a_member_meets_one_hub_a_round(spark, monkeypatch):
    rng, asked, given = random.Random(9), [], []
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    base, rows = rng.choices(words, k=120), []
    for i in range(900):
        own = list(base)
        for _ in range(rng.randint(2, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    confirm, blocks = minhash.confirm, minhash.confirm_blocks

    def counting(pairs, sets, percent):
        asked.append(pairs.count())
        return confirm(pairs, sets, percent)

    def forests(active, sets, percent):
        out = blocks(active, sets, percent)
        given.append((active.select("component").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "confirm", counting)
    monkeypatch.setattr(minhash, "confirm_blocks", forests)
    monkeypatch.setattr(minhash, "BLOCK", 100)  # so that buckets are many cells
    assert by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_duplicates(rows)
    assert asked and max(asked) <= len(rows)
    (components, links), = given
    assert links <= minhash.BANDS * components


# ------------------------------------------------------------ 10


@pytest.mark.parametrize("chunk_bytes", [backoff.CHUNK_BYTES, 9_000])
def test_scores(docs, corpus, chunk_bytes):
    want, model = brute.base_scores(plain(corpus)), brute.model_scores(plain(corpus), backoff.PRIORS)
    got = by_id(backoff.score(docs, chunk_bytes=chunk_bytes))
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    assert all(abs(got[k][4] - want[k][4]) < 1e-6 * max(1, abs(want[k][4])) for k in want)
    assert all(abs(got[k][5] - model[k]) < 1e-6 * max(1, abs(model[k])) for k in want)


def test_states_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b c a b d", "b c a", "", "c c c b a", "a b"]) if zlib.crc32(str(i).encode()) % 5 != 1]
    chunk = backoff.Chunk(pa.chunked_array([[t for _, t in rows]]), pa.chunked_array([[False] * len(rows)]))
    total, distinct = int(chunk.counts[np.unique(chunk.place[0])].sum()), len(np.unique(chunk.place[0]))
    for history in ("", "a", "a b", "b c", "zz a", "d zz"):
        texts = [f"{history} {w}".strip() for w in ("a", "b", "c", "d", "zz")] + [history]
        probe = backoff.Chunk(pa.chunked_array([texts]), pa.chunked_array([[True] * 6]))
        i = np.minimum(np.searchsorted(chunk.keys, probe.keys), len(chunk.keys) - 1)
        probe.counts = np.where((chunk.keys[i] == probe.keys) & (probe.keys > 0), chunk.counts[i], 0)
        one = np.log10((probe.counts[probe.place[0]] + backoff.PRIORS[0] / (distinct + 1)) / (total + backoff.PRIORS[0]))
        arc = probe.traverse(one, backoff.PRIORS, len(rows))
        n = len(history.split())
        assert abs(sum(10 ** arc[probe.at[:-1] + n]) - 1) < 1e-9


def test_packed_keys_and_counts():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (2, 300), (5000, 1 << 40)):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        counts = rng.integers(0, top, len(keys))
        assert (backoff.unpack_keys(backoff.pack_keys(keys)) == keys).all() and (backoff.unpack_counts(backoff.pack_counts(counts)) == counts).all()


# ------------------------------------------------------------ odd tables


OPERATORS = {
    "license": license_scan.license_scan, "tree": suffix_tree.repeated_words, "quality": quality.judge, "keep": quality.keep_good, "array": suffix_array.repeated_bytes, "bpe": byte_bpe.round_trip, "minhash": minhash.near_duplicates,
    "cut": suffix_tree.without_repeats, "dedup": minhash.without_near_duplicates, "lm": backoff.score,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_odd_tables(name, odd, empty):
    assert OPERATORS[name](empty).count() == 0
    out = OPERATORS[name](odd).collect()
    rows = [tuple(r) for r in out]
    if name in ("keep", "dedup"):
        assert len(rows) <= 6
    else:
        assert len(rows) == 6
        assert sum(r["doc_id"] is None for r in out) == 2
        assert any(rows.count(r) == 2 for r in rows if 1 in r[:1])  # repeated rows get equal results
    if name in ("keep", "cut", "dedup"):
        assert list(out[0].asDict()) == odd.columns if out else True


def test_toxicity_on_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (None, 1, "z"), (1, 1, "x")], "doc_id long, toxic int, score string")
    assert toxicity.score(empty, labels).count() == 0 and toxicity.score(odd, labels.limit(0)).count() == 6
    rows = [tuple(r) for r in toxicity.score(odd, labels).collect()]
    assert len(rows) == 6 and all(0 <= r[2] <= 1 for r in rows) and any(rows.count(r) == 2 for r in rows if r[0] == 1)
    long = spark.createDataFrame([(1, "bad word " * 300_000), (3, None), (3, "bad word " * 300_000)], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score(long, labels).filter("score IS NOT NULL").collect()}) <= 2


def test_extraction_on_odd_tables(spark):
    deep, wide = "<div>" * 30_000 + "<p>inside</p>", "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, "u", "<article><p>Text of it. More of it.</p></article>", "a", 1), (1, "u", "<article><p>Text of it. More of it.</p></article>", "a", 1), (None, None, None, None, None), (2, "v", "", "b", 2), (3, "w", deep, "c", 3), (4, "x", f"<article>{wide}</article>", "d", 4), (5, "y", "<a \"" * 50_000, "e", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.main_text(pages).collect()
    assert len(got) == 7 and [r["text"] for r in got if r["page_id"] == 1] == ["Text of it. More of it."] * 2
    assert next(r for r in got if r["page_id"] == 4)["n_chars"] == len("word " * 400_000) - 1
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_clashing_names_go_through(spark):
    rows = spark.createDataFrame([(i, f"w{i} " * 60, "en", 1, "2", 3.0, "4") for i in range(4)], "doc_id long, text string, lang string, _gone int, key_of_text string, model_of_row double, `row_found` string")
    bench = spark.createDataFrame([(1, "nothing like it anywhere")], "item_id long, text string")
    for found in (quality.keep_good(rows), minhash.without_near_duplicates(rows), suffix_tree.without_repeats(rows), decontaminate.without_leaks(rows, bench)):
        assert found.columns == rows.columns and found.count() <= 4
        found.collect()


def test_long_texts_and_decontamination(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    long = spark.createDataFrame([(1, "filler words here " * 150_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(long, bench).collect()] == [(1, 1, 0)]


def test_repeated_rows_are_one_document(odd):
    tree = [r for r in suffix_tree.repeated_words(odd).collect() if r["doc_id"] == 1]
    own = brute.repeated_words([(1, "a b c d e f " * 20)])[1]
    assert [tuple(r[1:]) for r in tree] == [own, own]
    array = [r for r in suffix_array.repeated_bytes(odd).collect() if r["doc_id"] == 1]
    own = brute.repeated_bytes([(1, "a b c d e f " * 20)])[1]
    assert [tuple(r[1:5]) for r in array] == [own, own]
    assert {r["component_id"] for r in minhash.near_duplicates(odd).collect() if r["doc_id"] == 1} == {1}


def test_leaks_on_odd_tables(odd, empty, spark):
    bench = spark.createDataFrame([(1, "first text here"), (1, "first text here"), (None, "x y z")], "item_id long, text string")
    assert decontaminate.without_leaks(empty, bench).count() == 0
    assert decontaminate.without_leaks(odd, bench).count() == 5 and decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    folder = tmp_path / "t"
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this kind stands anywhere here")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(folder))
        assert new.columns == docs.columns
        docs = spark.createDataFrame(new.collect(), new.schema)
    want = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, str(folder)).collect()} == want
