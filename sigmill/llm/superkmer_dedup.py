"""Substring dedup by super-k-mer partitioning, on words.

A window is ``window`` consecutive words of one document (words: runs of anything but ASCII white space). Runs of
windows that share a minimiser travel as one packed string to the minimiser's bucket, where sorting counts the
windows exactly; see repeats.py for the distributed part. Words covered by a window whose word sequence starts
anywhere else too are removed, all occurrences, judged on the input.

Null and empty texts have no words. Documents shorter than a window keep all words. Repeated rows repeat each
other's windows. A null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NO_ID, table
from .repeats import HOT, Sums, covered, mixed, repeated_windows

WINDOW = 35
GRAM = 8


def count_windows(window: int):
    """For packed runs of words and their numbers of windows: whether each window occurs twice among them."""

    def count(_, packed: list[bytes], n: np.ndarray) -> np.ndarray:
        code: dict[bytes, int] = {}
        ids = np.array([code.setdefault(w, len(code)) for p in packed for w in p.split()], np.int64)
        starts = np.cumsum(n + window - 1) - (n + window - 1)
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h = Sums(mixed(ids.astype(np.uint64), 4)).of(at, at + window)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        near = np.zeros(len(h), bool)
        near[1:] |= same
        near[:-1] |= same
        rows = order[near]  # only these can repeat; the sort of their word sequences decides
        dup = np.zeros(len(h), bool)
        if len(rows):
            words = np.ascontiguousarray(ids[at[rows][:, None] + np.arange(window)].astype(np.int32))
            _, back, counts = np.unique(words.view([("", np.void, words.itemsize * window)]).ravel(), return_inverse=True, return_counts=True)
            dup[rows] = counts[back] > 1
        return dup

    return count


def _kept(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split()
                gone = 0
                if spans:
                    drop = covered(spans, len(words), window)
                    gone = int(drop.sum())
                    kept = b" ".join([w for w, d in zip(words, drop.tolist()) if not d])
                else:
                    kept = b" ".join(words)
                out[0].append(len(words))
                out[1].append(gone)
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept.decode() if texts else None)
            done = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *done, *([pa.array(out[3], pa.string())] if texts else [])], [*batch.schema.names[2:], "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])

    return run


def superkmer_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept: the words left, joined by one space."""
    found = repeated_windows(docs.select("doc_id", "text"), "words", window, gram, count_windows(window), hot)
    rows = found.select("text", "spans", "k")
    out = rows.mapInArrow(_kept(window, keep_text), "k long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), *out.columns[1:])


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup(table(spark, sf_dir, "documents"), keep_text=False)
