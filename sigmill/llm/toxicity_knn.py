"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting. At most ``most_examples`` labelled documents of each class are taken, those with the smallest hash of
doc_id (the documented bound; it's what may be collected and broadcast). Terms are lower-cased words and word
beginnings of 4, 5 and 6 letters, so that inflected forms of one stem meet. The vocabulary keeps terms of at least
``min_df`` examples whose share of label 1 is ``min_share`` or more, whose association with the label has a
chi-square of 2 ln(number of terms tried) or more, so that chance adds about none, and which follow ``min_df``
different words in examples of label 1 (examples over 400 words count less), so that words which only copies of one text share stay out; the strongest
``most_terms`` of them, in turn, if they explain examples that no stronger one does. Examples are (1 + ln tf) * idf vectors of length 1.

Index. Examples are in blocks of 128. For each term the postings are in the order of the examples, with the
largest weight in each block. A query bounds each block by its terms' block maxima, visits blocks in descending
order of bound, scores them exactly, and stops when the next bound is under the kth score. Ties go to the example
with the smaller place, so the neighbours are those of a full scan.

Score. (sum of cosine * label + rate * smooth) / (sum of cosine + smooth), over the k nearest with a positive
cosine; rate is the share of label 1 in the labelled rows (learning folds). A text without a known term has score
rate. The evidence is the neighbours' doc_ids with their cosines.

A null text is empty; rows with null labels or null doc_id aren't learned from, and null doc_ids aren't held out; several
labels of one document count as label 1 if any does; of several texts of one labelled doc_id, the least is learned from.
Repeated rows are scored alike. Without a labelled example every score is 0. An empty table gives an empty result. Texts
of any length are scored whole, row by row without a shuffle; equal bags of known terms are scored once a worker (bounded
memory of results).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, held_out, materialize, small_batches, table

WORD = re.compile(r"[^\W\d_]+").findall
BLOCK = 128
#: A longer example counts as FULL / its number of words, as it holds many terms by chance.
FULL = 400
K = 24


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; '^' marks a beginning."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Index:
    """Examples' vectors by term, with block maxima."""

    def __init__(self, ids, labels, vectors: list[dict[int, float]], terms: int, k: int, rate: float, smooth: float):
        self.ids, self.labels, self.k, self.rate, self.smooth = np.asarray(ids, np.int64), np.asarray(labels, float), k, rate, smooth
        rows = [(t, d, w) for d, v in enumerate(vectors) for t, w in v.items()]
        rows.sort()
        t = np.array([r[0] for r in rows], np.int64)
        self.doc, self.weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        self.at = np.searchsorted(t, np.arange(terms + 1))
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        self.most = np.zeros((terms, self.blocks), np.float32)
        np.maximum.at(self.most, (t, self.doc // BLOCK), np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        # cut[t, b]: the first posting of term t in block b
        self.cut = np.stack([self.at[i] + np.searchsorted(self.doc[self.at[i] : self.at[i + 1]], np.arange(self.blocks + 1) * BLOCK) for i in range(terms)]) if terms else np.zeros((0, self.blocks + 1), np.int64)

    def nearest(self, query: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a positive cosine; query: (term, weight), length 1."""
        t, w = np.array([q[0] for q in query]), np.array([q[1] for q in query])
        bound = (w @ self.most[t]) * (1 + 1e-6)
        best, score = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == self.k and bound[b] < score[-1]:
                break
            sums = np.zeros(BLOCK)
            for i, x in zip(t, w):
                p, q = self.cut[i, b], self.cut[i, b + 1]
                if p < q:
                    sums[self.doc[p:q] - b * BLOCK] += x * self.weight[p:q]
            hit = np.flatnonzero(sums > 0)
            best, score = np.concatenate([best, hit + b * BLOCK]), np.concatenate([score, sums[hit]])
            order = np.lexsort((best, -score))[: self.k]
            best, score = best[order], score[order]
        return best, score

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float(((cosines * self.labels[places]).sum() + self.rate * self.smooth) / (cosines.sum() + self.smooth))


class Model:
    """What scoring needs: the vocabulary with idf, and the index. Its size is bounded by the fitting bounds."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, index: Index | None, rate: float):
        self.vocabulary, self.idf, self.index, self.rate = vocabulary, idf, index, rate
        self.stems = {w[1:5] for w in vocabulary if w[0] == "^"}
        self.words = {w for w in vocabulary if w[0] != "^"}

    def query(self, counts: Counter) -> list[tuple[int, float]]:
        v = [(t, (1.0 + np.log(n)) * self.idf[t]) for t, n in sorted(counts.items())]
        length = np.sqrt(sum(w * w for _, w in v))
        return [(t, w / length) for t, w in v]


def counted(words: list[str], vocabulary: dict[str, int], seen: dict[str, tuple], most: int = 200_000) -> Counter:
    """How often each known term is in the words; seen maps words to their known terms."""
    out: Counter = Counter()
    for w in words:
        got = seen.get(w)
        if got is None:
            if len(seen) >= most:
                seen.clear()
            got = seen[w] = tuple(vocabulary[t] for t in terms_of(w) if t in vocabulary)
        if got:
            out.update(got)
    return out


def _example_terms(batches):
    """(label, term, share) for each distinct term of each example, and for the empty term, which each has."""
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = WORD(text.lower())
            found = ["", *sorted({t for w in set(words) for t in terms_of(w)})]
            share = min(1.0, FULL / max(len(words), 1))
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int64()), pa.array(part, pa.string()), pa.array([share] * len(part))], ["label", "term", "share"])


def covering(examples: list[tuple[int, set[int]]], terms: int, min_share: float) -> list[int]:
    """Of terms 0, 1, .. (strongest first) those that explain two examples of label 1 or more which no stronger kept term
    explains, without holding too many of label 0, or that are in a twentieth of the examples of label 1 and almost only
    there: words that merely stand beside such terms go."""
    by: list[list[int]] = [[] for _ in range(terms)]
    for d, (_, bag) in enumerate(examples):
        for t in bag:
            by[t].append(d)
    toxic = sum(1 for label, _ in examples if label == 1)
    open_, kept = [label == 1 for label, _ in examples], []
    for t, docs in enumerate(by):
        new = [d for d in docs if open_[d]]
        clean = sum(1 for d in docs if examples[d][0] != 1)
        common = len(docs) - clean >= max(5, 0.05 * toxic) and clean <= 0.05 * len(docs)
        if common or len(new) >= 2 and len(new) >= min_share * (len(new) + clean):
            kept.append(t)
            for d in new:
                open_[d] = False
    return kept


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 4000, most_terms: int = 100_000, min_df: int = 3, min_share: float = 0.75, k: int = K, smooth: float = 1.5) -> Model:
    """docs: (doc_id, text); labels: (doc_id, label), only rows that may be learned from."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("long")).alias("label"))
    have = known.join(docs.select("doc_id").distinct(), "doc_id")  # examples whose text is there
    sizes = {r["label"]: r["count"] for r in have.groupBy("label").count().collect()}
    total = sum(sizes.values())
    rate = sizes.get(1, 0) / total if total else 0.0
    picked = [r for y in (0, 1) for r in have.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples).collect()]
    if not picked:
        return Model({}, np.zeros(0), None, 0.0)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(int(r["doc_id"]), int(r["label"])) for r in picked], "doc_id long, label long"))  # at most 2 * most_examples rows
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = materialize(rows)  # the bounded examples, read several times below
    terms = rows.select("label", "text").mapInArrow(_example_terms, "label long, term string, share double").groupBy("term").agg(F.sum("share").alias("df"), F.sum(F.col("label") * F.col("share")).alias("a"))
    terms = materialize(terms.where((F.col("df") >= min_df) | (F.col("term") == "")))
    whole = terms.where("term = ''").first()
    terms, n, n1 = terms.where(F.col("term") != ""), whole["df"], whole["a"]
    chi2 = F.expr(f"{n!r}D * pow(a * ({n - n1!r}D - (df - a)) - (df - a) * ({n1!r}D - a), 2) / greatest(df * ({n!r}D - df) * {n1!r}D * {n - n1!r}D, 1D)")
    tested = max(terms.count(), 2)
    strong = terms.where((F.col("a") / F.col("df") >= min_share)).withColumn("chi2", chi2).where(F.col("chi2") >= 2 * float(np.log(tested)))
    strong = materialize(strong)
    if strong.count() > most_terms:
        raise ValueError(f"more than {most_terms} terms go with the label; most_terms can be raised")
    candidates = spark.sparkContext.broadcast({r["term"] for r in strong.select("term").collect()})

    def contexts(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = WORD(text.lower())
                found = sorted({(t, p) for p, w in zip(["", *words], words) for t in terms_of(w) if t in candidates.value})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["term", "before"])

    varied = rows.where("label = 1").select("text").mapInArrow(contexts, "term string, before string").distinct().groupBy("term").count().where(F.col("count") >= min_df).select("term")
    kept = strong.join(varied, "term").orderBy(F.desc("chi2"), "term").collect()
    vocabulary = {r["term"]: i for i, r in enumerate(kept)}
    idf = np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in kept])
    shared = spark.sparkContext.broadcast(vocabulary)

    def vectors(batches):
        seen: dict[str, tuple] = {}
        for batch in batches:
            ids, ys, texts = (c.to_pylist() for c in batch.columns)
            bags = [sorted(counted(WORD(t.lower()), shared.value, seen).items()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int64()), pa.array([[t for t, _ in b] for b in bags], pa.list_(pa.int32())), pa.array([[c for _, c in b] for b in bags], pa.list_(pa.int32()))], ["doc_id", "label", "t", "c"])

    got = rows.mapInArrow(vectors, "doc_id long, label long, t array<int>, c array<int>").orderBy("doc_id").collect()  # bounded as chosen is
    need = covering([(r["label"], set(r["t"])) for r in got], len(kept), min_share)
    vocabulary = {kept[t]["term"]: i for i, t in enumerate(need)}
    idf, place = idf[need], {t: i for i, t in enumerate(need)}
    got = [{"doc_id": r["doc_id"], "label": r["label"]} | dict(zip("tc", zip(*[(place[t], c) for t, c in zip(r["t"], r["c"]) if t in place]) if any(t in place for t in r["t"]) else ((), ()))) for r in got]
    model = Model(vocabulary, idf, None, rate)
    bags = [dict(model.query(Counter(dict(zip(r["t"], r["c"]))))) if r["t"] else {} for r in got]
    model.index = Index([r["doc_id"] for r in got], [r["label"] for r in got], bags, len(vocabulary), k, rate, smooth)
    return model


def score(docs: DataFrame, model: Model, evidence: int = 4) -> DataFrame:
    """docs' columns and score, predicted, evidence (array of doc_id), cosines, which replace columns of these names."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        seen: dict[str, tuple] = {}
        done: dict[tuple, tuple] = {}
        plain = (m.rate, [], [])
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                bag = tuple(sorted(counted(WORD(text.lower()), m.vocabulary, seen).items())) if text else ()
                if not bag or m.index is None:
                    out.append(plain)
                    continue
                got = done.get(bag)
                if got is None:
                    places, cosines = m.index.nearest(m.query(Counter(dict(bag))))
                    got = (m.index.vote(places, cosines), m.index.ids[places[:evidence]].tolist(), [float(x) for x in cosines[:evidence]])
                    if len(done) > 50_000:
                        done.clear()
                    done[bag] = got
                out.append(got)
            s = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["row", "score", "predicted", "evidence", "cosines"])

    whole = docs.select(F.struct(*docs.columns).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    scored = whole.select(F.col("row.text").alias("text"), "row").mapInArrow(run, f"row {kind}, score double, predicted int, evidence array<long>, cosines array<double>")
    return scored.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted", "evidence", "cosines")], "score", "predicted", "evidence", "cosines")


def learnable(labels: DataFrame, column: str = "toxic") -> DataFrame:
    """(doc_id, label) of the folds that may be learned from."""
    return labels.where(fold("doc_id") != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))


def op2_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence", "cosines")
