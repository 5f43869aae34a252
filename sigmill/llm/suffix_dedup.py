"""Suffix-array dedup by bucket-pointer refinement, on UTF-8 bytes.

Texts are split by minimisers into buckets that hold every pair of equal ``length``-byte strings together (see
repeats.py). Within a bucket the suffixes of its regions are put in buckets by their first q bytes; each suffix
has a pointer to its bucket. Buckets with more than one suffix are refined by sorting on the pointers of later
offsets: pointers of depth h at offset h give depth 2h, and the refined pointers are reused for the next depth,
until depth ``length``. Suffixes still sharing a bucket then start with equal strings.

All bytes covered by a string that also starts anywhere else are removed, all occurrences, judged on the input;
matches never cross documents. Null and empty texts are empty. Repeated rows repeat each other. A null doc_id
stays null. An empty table gives an empty result. Text columns made of the bytes left drop the halves of
characters that a cut went through; the digest is of the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NO_ID, table
from .repeats import HOT, covered, repeated_windows

LENGTH = 400
GRAM = 128
Q = 8


def refine_buckets(text: np.ndarray, ends: np.ndarray, depth: int, q: int = Q) -> np.ndarray:
    """Positions whose next depth bytes, within the region that ends at ends[position], occur twice or more."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(q, np.uint8)])
    value = np.zeros(n, np.uint64)
    for i in range(q):
        value = value << np.uint64(8) | wide[i : i + n]
    pointer = np.arange(n, 2 * n)  # of suffixes that are alone or too short
    active = np.flatnonzero(np.arange(n) + q <= ends)
    old, key, h = np.zeros(len(active), np.int64), value[active], q
    while True:
        order = np.lexsort((key, old)) if h > q else np.argsort(key)
        s, o = key[order], old[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(s)))
        pos = active[order]
        pointer[pos] = np.repeat(heads, size)  # unique among buckets of this depth
        alone = np.repeat(size == 1, size)
        pointer[pos[alone]] = n + pos[alone]
        active = pos[~alone]
        if h == depth or not len(active):
            return active
        step = min(h, depth - h)
        short = active + h + step > ends[active]
        later = pointer[active[~short] + step]  # read before any pointer of this round is changed
        pointer[active[short]] = n + active[short]
        active = active[~short]
        old, key, h = pointer[active], later, h + step


def count_strings(length: int):
    """For packed regions and their numbers of windows: whether each window occurs twice among them."""

    def count(_, packed: list[bytes], n: np.ndarray) -> np.ndarray:
        sizes = n + length - 1
        text = np.frombuffer(b"".join(packed), np.uint8)
        ends = np.repeat(np.cumsum(sizes), sizes)
        hit = np.zeros(len(text), bool)
        hit[refine_buckets(text, ends, length)] = True
        at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return hit[at]

    return count


def _kept(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                gone = runs = 0
                kept = raw
                if spans:
                    drop = covered(spans, len(raw), length)
                    gone, runs = int(drop.sum()), int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~drop].tobytes()
                for c, v in zip(out, (len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if texts else None)):
                    c.append(v)
            done = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *done, *([pa.array(out[4], pa.string())] if texts else [])], [*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return run


FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept."""
    found = repeated_windows(docs.select("doc_id", "text"), "bytes", length, gram, count_strings(length), hot)
    out = found.select("text", "spans", "k").mapInArrow(_kept(length, keep_text), f"k long, {FIELDS}" + ", kept string" * keep_text)
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), *out.columns[1:])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with each text's repeated strings removed and the other columns unchanged; null texts become empty."""
    found = repeated_windows(docs, "bytes", length, gram, count_strings(length), hot, keep_rows=True)
    out = found.select("text", "spans", "row").mapInArrow(_kept(length, True), f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, {FIELDS}, kept string")
    return out.select(*[(F.col("kept") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)
