import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm.repeats import STEP, repeated_windows, word_units
from sigmill.llm.suffix_dedup import refine_buckets, suffix_dedup, without_repeats
from sigmill.llm.superkmer_dedup import count_windows, superkmer_dedup


def brute(texts, units, join, window):
    seqs = [units((t or "").encode()) for t in texts]
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        drop = [False] * (len(s) + 1)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                drop[i : i + window] = [True] * window
        kept = join([x for x, d in zip(s, drop) if not d])
        runs = sum(1 for i in range(len(s)) if drop[i] and (i == 0 or not drop[i - 1]))
        out.append((len(s), sum(drop[: len(s)]), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 0])
@pytest.mark.parametrize("window,gram", [(35, 8), (5, 2)])
def test_words_equal_brute_force(odd_docs, hot, window, gram):
    rows = odd_docs.collect()
    want = Counter((r.doc_id, a, b, d) for r, (a, b, _, d) in zip(rows, brute([r.text for r in rows], bytes.split, b" ".join, window)))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in superkmer_dedup(odd_docs, window, gram, hot, keep_text=False).collect())
    assert got == want


@pytest.mark.parametrize("hot", [512, 0])
def test_bytes_equal_brute_force(odd_docs, hot):
    docs = odd_docs.where("doc_id is null or doc_id <> 20")
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], lambda b: b, bytes, 100)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, 100, 40, hot, keep_text=False).collect())
    assert got == want


def test_kept_text_and_columns(odd_docs):
    out = without_repeats(odd_docs, 100, 40)
    assert out.columns == odd_docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "" and got[7].text == "one two" and got[4].text == "" and got[7].key == "clash"
    assert superkmer_dedup(odd_docs).where("doc_id = 7").first().kept == "one two"


def test_texts_without_id_that_agree_in_20_bits_of_their_hash(spark):
    text = " || ' ' || ".join(f"concat('w{j}x', id)" for j in range(8))
    some = spark.range(6000).selectExpr(f"{text} as text").selectExpr("text", "shiftrightunsigned(xxhash64(text), 44) as tag")
    a, b = some.groupBy("tag").agg(F.sort_array(F.collect_list("text")).alias("texts")).where("size(texts) = 2").orderBy("tag").first().texts
    rows = [(None, a), (1, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (512, 0):
        got = Counter((r.doc_id, r.n_words, r.n_removed) for r in superkmer_dedup(docs, 5, 2, hot, keep_text=False).collect())
        assert got == Counter([(None, 8, 8), (1, 8, 8), (None, 8, 0)])
        assert Counter((r.doc_id, r.kept) for r in suffix_dedup(docs, 20, 8, hot).collect()) == Counter([(None, ""), (1, ""), (None, b)])


def test_empty_table(no_docs):
    assert superkmer_dedup(no_docs).count() == 0 and suffix_dedup(no_docs).count() == 0


def test_refinement_against_counting():
    rng = np.random.default_rng(1)
    for depth in (16, 40, 100):
        text = rng.integers(97, 99, 3000).astype(np.uint8)
        text[1500:1800] = text[100:400]
        ends = np.where(np.arange(3000) < 1000, 1000, 3000)
        raw = text.tobytes()
        count = Counter(raw[i : i + depth] for i in range(3000) if i + depth <= ends[i])
        want = {i for i in range(3000) if i + depth <= ends[i] and count[raw[i : i + depth]] > 1}
        assert set(refine_buckets(text, ends, depth).tolist()) == want


def test_many_rows_without_id(spark):
    """3,000 null-id texts of differing length, and 2,000 rows that are equal in all columns."""
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(5 + i % 40))) for i in range(3000)]
    page = " ".join(f"page{j}" for j in range(60))
    docs = spark.createDataFrame(rows + [(None, page)] * 2000 + [(7, f"new {page} words")], "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in superkmer_dedup(docs, 20, 6, 4, keep_text=False).collect())
    want = Counter((None, len(t.split()), 0) for _, t in rows) + Counter({(None, 60, 60): 2000, (7, 62, 60): 1})
    assert got == want
    spans = repeated_windows(docs, "words", 20, 6, count_windows(20)).where("k is null or spans is not null")
    assert spans.selectExpr("max(size(spans))").first()[0] <= 41
    got = Counter((r.doc_id, r.n_removed > 0) for r in suffix_dedup(docs, 100, 40, 4, keep_text=False).collect())
    assert got == Counter({(None, False): 3000, (None, True): 2000, (7, True): 1})


def test_words_whose_sums_modulo_two_to_the_64_agree(spark):
    a = b"a"
    for _ in range(11):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    raw = np.frombuffer(a + b" " + b, np.uint8)
    u, _ = word_units(raw, np.array([0, len(raw)]))
    assert u[0] != u[1] and len(a) == 2048
    tail = " ".join(f"t{i}" for i in range(4))
    docs = spark.createDataFrame([(1, f"{a.decode()} {tail}"), (2, f"{b.decode()} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in superkmer_dedup(docs, 5, 2, keep_text=False).collect()] == [0, 0]


def test_hot_buckets_are_split_exactly(spark):
    """One passage in many texts whose other words differ: one bucket with many kinds of runs."""
    core = [f"core{i}" for i in range(12)]
    rows = [(i, " ".join([f"a{i % 7}", f"b{i}", *core, f"c{i % 5}", f"d{i}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, a, b, d) for (i, _), (a, b, _, d) in zip(rows, brute([t for _, t in rows], bytes.split, b" ".join, 13)))
    for hot in (0, 8, 512):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in superkmer_dedup(docs, 13, 4, hot, keep_text=False).collect())
        assert got == want


def test_parameters_that_places_cannot_hold(no_docs):
    with pytest.raises(ValueError):
        superkmer_dedup(no_docs, 1100, 8)


def test_texts_longer_than_a_step(spark):
    rng = np.random.default_rng(3)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**7, 90_000)) for _ in range(3)]
    page = " ".join(f"p{x}" for x in rng.integers(0, 10**7, 100))
    a = own[0] + " " + page + " " + own[1]
    docs = spark.createDataFrame([(1, a), (2, f"{own[2]} {page} {own[2][:30]}"), (3, a)], "doc_id long, text string")
    assert len(a) > 4 * STEP
    got = {r.doc_id: r.n_removed for r in superkmer_dedup(docs, keep_text=False).collect()}
    assert got == {1: 180_100, 2: 100, 3: 180_100}
    got = {r.doc_id: r.n_removed for r in suffix_dedup(docs, keep_text=False).collect()}
    assert got[1] == got[3] == len(a) and len(page) <= got[2] <= len(page) + 4
