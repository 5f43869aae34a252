import random

import numpy as np
import pytest

from sigmill.llm import language_crf as L


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    for lengths in ([1], [5, 1, 40], [100, 33, 32, 64, 2]):
        lengths = np.array(lengths)
        e, moves = rng.random((lengths.sum(), 3)) + 0.01, rng.normal(size=(3, 3))
        p, a, s = L.marginals(e, lengths, moves), np.exp(moves), 0
        for n in lengths:
            own, f, v, w = e[s : s + n], [], np.full(3, 1 / 3), np.ones(3)
            for x in own:
                v = (v @ a) * x
                v /= v.sum()
                f.append(v)
            for t in range(n - 1, -1, -1):
                g = f[t] * w
                assert np.allclose(g / g.sum(), p[s + t])
                w = a @ (own[t] * w)
                w /= w.sum()
            s += n


def test_expected_moves_are_the_gradient():
    rng = np.random.default_rng(1)
    e, lengths, moves = rng.random((12, 3)) + 0.1, np.array([7, 5]), rng.normal(size=(3, 3)) * 0.3
    got = L._pairs(e, lengths, moves)

    def log_z(m):
        a, total, s = np.exp(m), 0.0, 0
        for n in lengths:
            v = np.full(3, 1 / 3) @ np.exp(moves) * e[s]  # the first step's move isn't a pair inside the text
            for x in e[s + 1 : s + n]:
                v = (v @ a) * x
            total += np.log(v.sum())
            s += n
        return total

    for i in range(3):
        for j in range(3):
            d = np.zeros((3, 3))
            d[i, j] = 1e-5
            assert abs((log_z(moves + d) - log_z(moves - d)) / 2e-5 - got[i, j]) < 1e-4


def corpus(spark):
    r = random.Random(4)
    parts = {"aa": ["the", "ing", "tion", "sh"], "bb": ["der", "sch", "keit", "ung"], "cc": ["que", "eau", "oux", "ment"]}
    word = lambda y: "".join(r.choice(parts[y]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word(y) for _ in range(r.randrange(5, 60))), y) for i in range(300) for y in [r.choice(list(parts))]]
    return rows, word, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_and_code_switching(spark, odd_docs, no_docs):
    rows, word, docs = corpus(spark)
    chain = L.fit(docs.where("doc_id % 4 <> 0"), most_docs=60)
    got = {r.doc_id: r for r in L.predict(docs, chain).collect()}
    assert np.mean([got[i].lang_pred == y for i, _, y in rows if i % 4 == 0]) > 0.97
    mixed = " ".join([word("aa") for _ in range(30)] + [word("bb") for _ in range(50)])
    two = L.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), chain).first()
    assert two.lang_pred == "bb" and two.switches >= 1 and abs(two.shares["aa"] - 30 / 80) < 0.15
    odd = L.predict(odd_docs, chain).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 9)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert L.predict(no_docs, chain).count() == 0


def test_nothing_to_learn_from(odd_docs, no_docs):
    assert {r.lang_pred for r in L.predict(odd_docs, L.fit(no_docs)).collect()} == {"und"}


def test_labels_beyond_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"word{'abc'[i % 3]} text", "abc"[i % 3]) for i in range(9)], "doc_id long, text string, lang string")
    assert sorted(L.fit(docs, most_labels=3).labels) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        L.fit(docs, most_labels=2)


def test_words_are_letters_with_their_marks():
    assert L.WORD("हिन्दी x1y ² ½ Ⅷ don't") == ["हिन्दी", "x", "y", "don", "t"]


def test_query_against_plain_forward_backward(spark, tmp_path):
    import zlib

    rows, _, _ = corpus(spark)
    rows = [*rows, (1000, "² ½ Ⅷ 12", "aa"), (1001, None, "bb"), (None, rows[0][1], "cc"), (1002, "", None), (rows[1][0], rows[1][1], rows[1][2])]
    spark.createDataFrame([(i, t, y, "s", 1) for i, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op1_language_crf(spark, str(tmp_path)).collect()
    chain = L.fit(spark.read.parquet(str(tmp_path / "documents.parquet")).where(L.fold("doc_id") != 0))
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    text = {i: t for i, t, _ in rows}
    moves = np.exp(chain.moves - chain.moves.max())
    for r in got:
        words = L.WORD((text[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        e = chain.potentials(words)
        f, b = [np.full(len(chain.labels), 1.0) @ moves * e[0]], [np.ones(len(chain.labels))]
        for x in e[1:]:
            f.append((f[-1] / f[-1].sum()) @ moves * x)
        for x in e[:0:-1]:
            b.append(moves @ (x * b[-1] / b[-1].sum()))
        p = np.array(f) * np.array(b[::-1])
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert abs(mean.max() - r.score) < 1e-9 and chain.labels[int(mean.argmax())] == r.lang_pred
