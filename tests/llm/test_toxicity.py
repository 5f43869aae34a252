import random

import numpy as np

from sigmill.llm import toxicity_knn as T


def test_index_equals_full_scan():
    r = random.Random(2)
    vectors = []
    for _ in range(700):
        v = {t: r.choice([0.5, 1.0, 2.0]) for t in r.sample(range(60), r.randrange(0, 8))}
        n = np.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({t: x / n for t, x in v.items()})
    index = T.Index(range(700), [i % 2 for i in range(700)], vectors, 60, 10, 0.3, 1.0)
    for q in vectors[:80]:
        if not q:
            continue
        places, cosines = index.nearest(sorted(q.items()))
        full = np.array([sum(q.get(t, 0) * w for t, w in v.items()) for v in vectors])
        want = [i for i in sorted(range(700), key=lambda i: (-round(full[i], 12), i)) if full[i] > 0][:10]
        assert np.allclose(cosines, full[want]) and np.allclose(full[places], full[want])


def test_held_out_accuracy_and_odd_rows(spark, odd_docs):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        w = [r.choice(words) for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(["idiotic", "Idiots", "scum"])
        rows.append((i, " ".join(w), int(toxic)))
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(all_rows.where("doc_id % 3 <> 0").select("doc_id", "text"), all_rows.where("doc_id % 3 <> 0").selectExpr("doc_id", "toxic as label"))
    got = T.score(all_rows, model).where("doc_id % 3 = 0").collect()
    assert np.mean([x.predicted == x.toxic for x in got]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    odd = T.score(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.where("text is null and score is null").count() == 0 and "key" in odd.columns


def test_nothing_to_learn_from(odd_docs, no_docs, spark):
    model = T.fit(odd_docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {x.score for x in T.score(odd_docs, model).collect()} == {0.0}
    assert T.score(no_docs, model).count() == 0


def test_labels_of_fold_zero_are_left_out(spark):
    labels = spark.range(100).selectExpr("id as doc_id", "1 as toxic")
    import zlib

    assert {r.doc_id for r in T.learnable(labels).collect()} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_whole_query_equals_brute_force(spark, tmp_path):
    """op2 on a small table against neighbours by full scans, and its calibration on the held-out fold."""
    import zlib

    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randrange(1, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w) + 1), r.choice(["rottenish", "Vilest", "scummy", "grimelord"]))
        rows.append((i, " ".join(w) if i % 97 else None, "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows.append((None, "scummy vilest", None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op2_toxicity_knn(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = T.fit(docs.select("doc_id", "text"), T.learnable(spark.read.parquet(str(tmp_path / "labels.parquet"))))
    vectors = [{} for _ in model.index.ids]
    for t in range(len(model.vocabulary)):
        for i in range(model.index.at[t], model.index.at[t + 1]):
            vectors[model.index.doc[i]][t] = model.index.weight[i]
    text, label = {i: t or "" for i, t, *_ in rows}, {i: y for i, _, y in labels}
    for x in got:
        bag = {}
        for w in T.WORD(text[x.doc_id].lower()):
            for t in T.terms_of(w):
                if t in model.vocabulary:
                    bag[model.vocabulary[t]] = bag.get(model.vocabulary[t], 0) + 1
        q = {t: (1 + np.log(n)) * model.idf[t] for t, n in bag.items()}
        norm = np.sqrt(sum(w * w for w in q.values())) or 1
        near = sorted((-round(sum(w / norm * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors))[: model.index.k]
        near = [(-c, i) for c, i in near if c < 0]
        want = (sum(c * model.index.labels[i] for c, i in near) + model.rate * model.index.smooth) / (sum(c for c, _ in near) + model.index.smooth)
        assert abs(x.score - want) < 1e-6 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [(x.score, label[x.doc_id]) for x in got if x.held_out and x.doc_id % 97]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97 and np.mean([(s - y) ** 2 for s, y in held]) < 0.03
