"""Language identification by a linear-chain conditional random field over words.

Words are letters (Unicode's category L) with the letters and combining marks that follow, lower-cased. A word's features are its affixes of 1 to 3 letters, its letter 2- and
3-grams with the word's ends marked, and a lexicon entry (the label that most of the word's uses in the sample
have). With one weight a feature and label, and one a pair of labels in a row, the chain gives each word's label
probabilities by forward-backward, so a text that switches languages is labelled word by word. The document's
prediction is the label with the largest mean probability; that mean is its score.

Fitting. At most ``most_docs`` documents a label (those with the smallest hash of doc_id) are collected with their whole
texts; these two numbers and ``most_labels`` bound the rows, and more labels raise ValueError, so that each is learned. A
text's words are all trained on, in sequences of ``window`` words; half of the sequences get a third from another text, so
that transitions are learned. Weights are fitted by AdaGrad on the exact gradient with a fixed order, so equal inputs give
equal models.

Forward-backward over a batch is exact for texts of any length: each text is cut into chunks of 32 words, the
chunks' transfer matrices are multiplied for all chunks at once, prefixes and suffixes are carried over chunks, and
the words' marginals follow inside the chunks.

Texts that are null or without letters get 'und' and score 0, as all do if nothing can be learned. Rows with null
lang or doc_id aren't learned from; null doc_ids are predicted and not held out. Repeated rows are predicted alike, and of
several texts of one doc_id and label the least is learned from. Of labels with equal means the first in sorted order is
predicted. An empty table gives an empty result. Predicting doesn't shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fold, held_out, small_batches, table

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
CHUNK = 32


def features(word: str) -> list[str]:
    s = f"<{word}>"
    out = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    out += [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)]
    return out


class Chain:
    """Weights, and the words seen so far with their label potentials."""

    def __init__(self, labels: list[str], index: dict[str, int], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.index, self.lexicon, self.weights, self.moves = labels, index, lexicon, weights, moves
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(labels)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": np.zeros((0, len(self.labels)))}

    def own(self, word: str) -> list[int]:
        """The word's feature rows."""
        out = [i for f in features(word) if (i := self.index.get(f)) is not None]
        if (i := self.lexicon.get(word)) is not None:
            out.append(i)
        return out

    def rows(self, words: list[str], memo: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of words, concatenated, and where each word's begin; memo: those of known words."""
        flat, starts = [], [0]
        for w in words:
            flat += self.own(w) if memo is None else memo[w]
            starts.append(len(flat))
        return np.array(flat, np.int64), np.array(starts)

    def potentials(self, words: list[str], most: int = 400_000) -> np.ndarray:
        """(words, labels): exp of the label scores, scaled to a largest of 1."""
        known = self.known
        try:
            return self.table[[known[w] for w in words]]
        except KeyError:
            pass
        new = list({w for w in words if w not in known})
        if known and len(known) + len(new) > most:
            known.clear()
            self.table = self.table[:0]
            new = list(set(words))
        flat, starts = self.rows(new)
        sums = np.zeros((len(flat) + 1, len(self.labels)))
        np.cumsum(self.weights[flat], axis=0, out=sums[1:])
        score = sums[starts[1:]] - sums[starts[:-1]]
        known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, np.exp(score - score.max(axis=1, keepdims=True))])
        return self.table[[known[w] for w in words]]


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(words, labels) probabilities; e: potentials of consecutive texts with lengths words each (all over 0)."""
    a = np.exp(moves - moves.max())
    labels = e.shape[1]
    per = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    chunks = int(per.sum())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.repeat(starts, per) + CHUNK * (np.arange(chunks) - np.repeat(first, per))
    size = np.minimum(CHUNK, np.repeat(starts + lengths, per) - at)
    order = np.argsort(-size, kind="stable")  # full chunks first: step i works on a prefix
    at, size = at[order], size[order]
    place = np.empty(chunks, np.int64)
    place[order] = np.arange(chunks)
    live = [int(np.searchsorted(-size, -i, "left")) for i in range(CHUNK)]  # chunks with more than i words
    transfer = np.broadcast_to(np.eye(labels), (chunks, labels, labels)).copy()
    for i, n in enumerate(live):
        if n:
            t = (transfer[:n] @ a) * e[at[:n] + i][:, None, :]
            transfer[:n] = t / t.max(axis=(1, 2), keepdims=True)
    by = np.argsort(-per, kind="stable")
    head, tail = np.zeros((chunks, labels)), np.zeros((chunks, labels))
    v, w = np.full((len(per), labels), 1.0 / labels), np.ones((len(per), labels))
    for j in range(int(per.max())):
        t = by[: int(np.searchsorted(-per[by], -j, "left"))]
        c = place[first[t] + j]
        head[c] = v[t]
        x = np.einsum("tk,tkl->tl", v[t], transfer[c])
        v[t] = x / x.sum(axis=1, keepdims=True)
        c = place[first[t] + per[t] - 1 - j]
        tail[c] = w[t]
        x = np.einsum("tkl,tl->tk", transfer[c], w[t])
        w[t] = x / x.sum(axis=1, keepdims=True)
    out = np.empty_like(e)
    for i, n in enumerate(live):
        if n:
            x = (head[:n] @ a) * e[at[:n] + i]
            head[:n] = x / x.sum(axis=1, keepdims=True)
            out[at[:n] + i] = head[:n]
    for i in range(CHUNK - 1, -1, -1):
        if n := live[i]:
            rows = at[:n] + i
            x = out[rows] * tail[:n]
            out[rows] = x / x.sum(axis=1, keepdims=True)
            x = (tail[:n] * e[rows]) @ a.T
            tail[:n] = x / x.sum(axis=1, keepdims=True)
    return out


def train(samples: dict[str, list[list[str]]], epochs: int = 3, rate: float = 0.3, batch: int = 32, seed: int = 5) -> Chain:
    """samples: sequences of words by label."""
    labels = sorted(samples)
    k = len(labels)
    uses: dict[str, Counter] = {}
    for y, name in enumerate(labels):
        for words in samples[name]:
            for w in words:
                uses.setdefault(w, Counter())[y] += 1
    counts = Counter(f for w in uses for f in set(features(w)))
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 1))}
    lexicon = {w: len(index) + c.most_common(1)[0][0] for w, c in sorted(uses.items()) if sum(c.values()) > 2 and c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
    size = len(index) + k
    chain = Chain(labels, index, lexicon, np.zeros((size, k)), np.zeros((k, k)))
    memo = {w: chain.own(w) for w in uses}
    rng = np.random.default_rng(seed)
    pool = [(y, words) for y, name in enumerate(labels) for words in samples[name] if words]
    squares, move_squares = np.full((size, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(pool))
        for b in range(0, len(order), batch):
            words, gold, lengths = [], [], []
            for i in order[b : b + batch]:
                y, own = pool[i]
                parts = [(y, own)]
                if rng.random() < 0.5:
                    third = max(1, len(own) // 3)
                    y2, other = pool[rng.integers(len(pool))]
                    parts = [(y, own[:third]), (y2, other[third : 2 * third] or other[:third]), (y, own[2 * third :])]
                n = len(words)
                for yy, ws in parts:
                    words += ws
                    gold += [yy] * len(ws)
                lengths.append(len(words) - n)
            flat, starts = chain.rows(words, memo)
            sums = np.zeros((len(flat) + 1, k))
            np.cumsum(chain.weights[flat], axis=0, out=sums[1:])
            score = sums[starts[1:]] - sums[starts[:-1]]
            e = np.exp(score - score.max(axis=1, keepdims=True))
            lengths, gold = np.array(lengths), np.array(gold)
            p = marginals(e, lengths, chain.moves)
            diff = -p
            diff[np.arange(len(gold)), gold] += 1
            grad = np.zeros((size, k))
            np.add.at(grad, flat, np.repeat(diff, np.diff(starts), axis=0))
            grad /= len(lengths)
            grad -= 1e-4 * chain.weights
            squares += grad * grad
            chain.weights += rate * grad / np.sqrt(squares)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths) - 1] = False
            i = np.flatnonzero(inner)
            # pair marginals from neighbours' marginals under the chain: a move's expected count
            joint = _pairs(e, lengths, chain.moves)
            move = -joint
            np.add.at(move, (gold[i], gold[i + 1]), 1)
            move = move / len(lengths) - 1e-3 * chain.moves
            move_squares += move * move
            chain.moves += rate * move / np.sqrt(move_squares)
    return chain


def _pairs(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected number of each move inside the texts, by plain forward-backward over texts side by side."""
    a, k = np.exp(moves - moves.max()), e.shape[1]
    top, n = int(lengths.max()), len(lengths)
    starts = np.cumsum(lengths) - lengths
    side = np.ones((n, top, k))
    for r in range(n):
        side[r, : lengths[r]] = e[starts[r] : starts[r] + lengths[r]]
    f = np.zeros((n, top, k))
    v = np.full((n, k), 1.0 / k)
    for t in range(top):
        v = (v @ a) * side[:, t]
        v /= v.sum(axis=1, keepdims=True)
        f[:, t] = v
    total, w = np.zeros((k, k)), np.ones((n, k))
    for t in range(top - 1, 0, -1):
        w = np.where((t >= lengths - 1)[:, None], 1.0, w)
        x = side[:, t] * w
        j = f[:, t - 1][:, :, None] * a[None] * x[:, None, :]
        j /= j.sum(axis=(1, 2), keepdims=True)
        total += j[t < lengths].sum(axis=0)
        w = x @ a.T
        w /= w.sum(axis=1, keepdims=True)
    return total


def fit(docs: DataFrame, most_docs: int = 150, window: int = 60, most_labels: int = 64, salts: int = 16) -> Chain:
    """docs: (doc_id, text, lang), only rows that may be learned from."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    if known.select("lang").distinct().limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} labels; most_labels can be raised")
    ranked = known.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    for by in (["lang", "salt"], ["lang"]):  # so that a label with most of the rows is first ranked in parts
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("r") <= most_docs)
    chosen = F.broadcast(ranked.select("doc_id", F.col("lang").alias("label")).distinct())  # at most most_docs * most_labels rows
    rows = known.join(chosen, "doc_id").where("lang = label").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["doc_id"])):
        words = WORD(r["text"].lower())
        samples.setdefault(r["label"], []).extend(words[i : i + window] for i in range(0, len(words), window))
    samples = {label: pieces for label, pieces in samples.items() if pieces}
    return train(samples) if samples else Chain([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))


def predict(docs: DataFrame, chain: Chain, step: int = 40_000) -> DataFrame:
    """doc_id, lang_pred, score, n_words, switches (neighbouring words whose likeliest labels differ) and shares by label."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        c = shared.value
        k = len(c.labels)

        def settle(ids, words, lengths):
            lengths = np.array(lengths, np.int64)
            n = len(lengths)
            shares, switches = np.zeros((n, k)), np.zeros(n, np.int64)
            some = np.flatnonzero(lengths)
            if len(some) and k:
                p = marginals(c.potentials(words), lengths[some], c.moves)
                starts = np.cumsum(lengths[some]) - lengths[some]
                shares[some] = np.add.reduceat(p, starts, axis=0) / lengths[some][:, None]
                best = p.argmax(axis=1)
                change = np.zeros(len(best), np.int64)
                change[1:] = best[1:] != best[:-1]
                change[starts] = 0
                switches[some] = np.add.reduceat(change, starts)
            has = (lengths > 0) & (k > 0)
            top = shares.argmax(axis=1) if k else np.zeros(n, np.int64)
            names = [c.labels[t] if h else "und" for t, h in zip(top.tolist(), has.tolist())]
            score = np.where(has, shares.max(axis=1), 0.0) if k else np.zeros(n)
            maps = [list(zip(c.labels, s)) if h else [] for s, h in zip(shares.tolist(), has.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(np.clip(score, 0, 1)), pa.array(lengths), pa.array(switches), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "n_words", "switches", "shares"])

        ids, words, lengths = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = WORD(text.lower()) if text else []
                ids.append(doc_id)
                words += found
                lengths.append(len(found))
                if len(words) > step:
                    yield settle(ids, words, lengths)
                    ids, words, lengths = [], [], []
        if ids:
            yield settle(ids, words, lengths)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, switches long, shares map<string,double>")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chain = fit(docs.where(fold("doc_id") != 0))
    return predict(docs, chain).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score", "n_words", "switches", "shares")
