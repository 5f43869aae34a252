"""Windows that occur more than once: the distributed part that substring and suffix-array dedup share.

A document is a sequence of units (words or bytes). Each window of ``window`` units has a minimiser, the leftmost
``gram``-unit gram with the smallest hash. Consecutive windows with the same minimiser occurrence are one run, a
super-k-mer of n windows over n - 1 + window units. Equal windows have equal minimisers at equal offsets, so they
lie in runs of the same bucket (the minimiser's hash), and never twice in one run. That gives these steps:

1. Runs are listed as six longs (minimiser, two digests of the run, document, text's hash, place) in a table; no text
   travels. Only buckets with two or more runs can hold a repeat; map-side sums find them and a join, which AQE may split,
   keeps those.
2. Runs of one bucket that agree in both digests are copies: all their windows repeat. The digests are independent, 64 bits
   of a sum modulo 2**64 and 62 of two sums modulo a prime. Copies are counted map-side, so a passage that fills a third
   of the table is one row a map task. One of them goes on.
3. What is left, different runs in one bucket, is cut from the texts and sent, packed, to its bucket, where
   ``count_bucket`` sorts the windows exactly.
4. A bucket of more than ``hot`` different runs isn't sent to one task. Its runs are cut into shorter ones by the
   minimisers of longer grams, and steps 1 to 3 are done again with these buckets, which are smaller and as exact: equal
   windows agree in these minimisers too. The last grams are whole windows, whose buckets hold one kind of run.

Rows are known by doc_id and the text's 64-bit hash, so repeated rows and different texts under one id or none work; a
row's places are kept once, however often the row is repeated. A very long text is scanned whole, in overlapping parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.store import drop_tables, tables_written
from .common import NO_ID, keyed, materialize, slices, small_batches, text_buffer

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_BACK = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one set of arrays covers; a longer document is taken alone, in parts that overlap by a window.
STEP = 1 << 18
#: Different runs that a bucket may have if one task is to sort it: a few MB of text.
HOT = 4096
PRIME = np.int64(2**31 - 1)
#: Bases of the two sums modulo PRIME.
PRIME_BASES = (1_103_515_245, 48_271_977)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finalizer of splitmix, in place on a copy."""
    x = x + U((salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_HASH = mixed(np.arange(256, dtype=U), 7)


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for b in (BASE, BASE_BACK):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(18, int(n + 1).bit_length()))


class Sums:
    """Hashes of ranges of units by prefix sums modulo 2**64."""

    def __init__(self, u: np.ndarray):
        pw, self.back = powers(len(u))
        self.d = np.zeros(len(u) + 1, U)
        np.cumsum(u * pw[: len(u)], out=self.d[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.d[b] - self.d[a]) * self.back[a]

    def grams(self, m: int) -> np.ndarray:
        return (self.d[m:] - self.d[:-m]) * self.back[: len(self.d) - m]


@lru_cache(4)
def _prime_powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, int(PRIME))):
        p = np.ones(1, np.int64)
        while len(p) < 1 << bits:
            p = np.concatenate([p, p * pow(b, len(p), int(PRIME)) % PRIME])
        out.append(p)
    return out[0], out[1]


class PrimeSums:
    """62-bit hashes of ranges of units by two prefix sums modulo 2**31 - 1, independent of those of Sums."""

    def __init__(self, u: np.ndarray):
        bits = max(18, int(len(u) + 1).bit_length())
        self.parts = []
        for shift, base in zip((0, 33), PRIME_BASES):
            pw, back = _prime_powers(bits, base)
            d = np.zeros(len(u) + 1, np.int64)
            small = (u >> U(shift)).astype(np.int64) & np.int64(2**31 - 1)
            np.cumsum(small * pw[: len(u)] % PRIME, out=d[1:])
            self.parts.append((d, back))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = ((d[b] - d[a]) % PRIME * back[a] % PRIME for d, back in self.parts)
        return low | high << np.int64(31)


def word_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and each text's range of them."""
    word = ~SPACE[raw]
    first, last = word.copy(), word.copy()
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    u, i = np.zeros(len(a), U), 0
    while i < len(a):  # words of about STEP bytes at a time
        j = max(i + 1, int(np.searchsorted(b, a[i] + 4 * STEP, "right")))
        byte, x, y = BYTE_HASH[raw[a[i] : b[j - 1]]], a[i:j] - a[i], b[i:j] - a[i]
        u[i:j] = mixed(Sums(byte).of(x, y) ^ mixed(PrimeSums(byte).of(x, y).view(U), 12), 3)
        i = j
    return u, np.searchsorted(a, off)


def byte_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[raw], off


UNITS = {"words": word_units, "bytes": byte_units}


def find_runs(u: np.ndarray, off: np.ndarray, window: int, gram: int):
    """(text, first window, windows, minimiser, two digests) of each run."""
    n = len(u)
    lengths = np.diff(off)
    if n < window or not (lengths >= window).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    sums = Sums(u)
    g = mixed(sums.grams(gram), 1)
    mask = U((1 << int(n).bit_length()) - 1)
    low = (g & ~mask) | np.arange(len(g), dtype=U)
    span, width = 1, window - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & mask).astype(np.int64)
    edge = np.zeros(n + 2, np.int32)
    long = lengths >= window
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[: len(at)]) > 0)
    p = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    a, count = starts[heads], np.diff(np.append(heads, len(starts)))
    p = p[heads]
    digest = mixed(sums.of(a, a + count - 1 + window) ^ mixed(((p - a) * 4096 + count).astype(U), 5), 2)
    text = np.searchsorted(off, a, "right") - 1
    return text, a - off[text], count, g[p].view(np.int64), digest.view(np.int64), PrimeSums(u).of(a, a + count - 1 + window)


# A place is the first window above 10 bits of windows - 1.
def place(first, count):
    return first << 10 | (count - 1)


FIRST = "shiftright(place, 10)"
COUNT = "((place & 1023) + 1)"


def _scan(unit: str, window: int, gram: int):
    def run(batches):
        for batch in batches:
            off, raw = text_buffer(batch.column(2))
            k = batch.column(0).to_numpy()
            th = batch.column(1).to_numpy()
            for i, j in slices(off, STEP):
                for first, u, uoff in _parts(unit, raw[off[i] : off[j]], off[i : j + 1] - off[i], window):
                    t, a, n, mh, dg, dg2 = find_runs(u, uoff, window, gram)
                    if len(t):
                        yield _listed(mh, dg, dg2, k[i:j][t], th[i:j][t], place(first + a, n))

    return run


def _parts(unit: str, raw: np.ndarray, off: np.ndarray, window: int):
    """(first unit, units, offsets) of texts of about STEP bytes together, or of each part of one longer text. A run that a
    part's end cuts in two is two runs; the windows are the same."""
    if len(raw) <= 2 * STEP:
        yield 0, *UNITS[unit](raw, off)
        return
    units = raw if unit == "bytes" else word_units(raw, off)[0]
    size = STEP if unit == "bytes" else STEP // 4
    for i in range(0, len(units) - window + 1, size):
        part = units[i : i + size + window - 1]
        yield i, (BYTE_HASH[part] if unit == "bytes" else part), np.array([0, len(part)])


RUN = "mh long, dg long, dg2 long, k long, th long, place long"


def _listed(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mh", "dg", "dg2", "k", "th", "place"])


def _once(batch, seen: list):
    """The rows of the batch (k, th, text, runs); of neighbouring equal (k, th), one. The others are repeated rows."""
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        if row[:2] != tuple(seen):
            seen[:] = row[:2]
            yield row


def _cut(unit: str, window: int):
    """Rows (k, th, text, runs of (mh, place)) to packed runs."""

    def run(batches):
        seen: list = []
        for batch in batches:
            out = ([], [], [], [], [])
            size = 0
            for k, th, text, runs in _once(batch, seen):
                raw = text.encode()
                words = raw.split() if unit == "words" else None
                for r in runs:
                    first, n = r["place"] >> 10, (r["place"] & 1023) + 1
                    piece = raw[first : first + n - 1 + window] if words is None else b" ".join(words[first : first + n - 1 + window])
                    for c, v in zip(out, (r["mh"], k, th, r["place"], piece)):
                        c.append(v)
                    size += len(piece)
                if size > 4_000_000:
                    yield _packed(out)
                    out, size = ([], [], [], [], []), 0
            if out[0]:
                yield _packed(out)

    return run


def _packed(out):
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["mh", "k", "th", "place", "packed"])


def _rescan(unit: str, window: int, gram: int):
    """Rows (k, th, text, runs of (mh, place)) to shorter runs, by the minimisers of these runs and of longer grams."""

    def run(batches):
        seen: list = []
        for batch in batches:
            for k, th, text, runs in _once(batch, seen):
                raw = np.frombuffer(text.encode(), np.uint8)
                u, _ = UNITS[unit](raw, np.array([0, len(raw)]))
                runs.sort(key=lambda r: r["place"])
                first = np.array([r["place"] >> 10 for r in runs])
                size = np.array([(r["place"] & 1023) + window for r in runs])
                old = np.array([r["mh"] for r in runs], np.int64).view(U)
                off = np.concatenate([[0], np.cumsum(size)])
                for i, j in slices(off, STEP):
                    at = np.repeat(first[i:j] - (off[i:j] - off[i]), size[i:j]) + np.arange(off[j] - off[i])
                    t, a, n, mh, dg, dg2 = find_runs(u[at], off[i : j + 1] - off[i], window, gram)
                    both = mixed(mixed(old[i + t], 14) ^ mh.view(U), 15).view(np.int64)
                    yield _listed(both, dg, dg2, np.full(len(t), k, np.int64), np.full(len(t), th, np.int64), place(first[i + t] + a, n))

    return run


#: At most so many bits mark wanted ids; beyond about as many ids the map lets all pass, and the join decides.
MOST_BITS = 1 << 26


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(U), 60) & U(bits - 1)


def _marks(bits):
    """(word, mark) for the ids of a partition."""

    def run(batches):
        marks = np.zeros(bits // 64, U)
        for batch in batches:
            at = _slot(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(marks, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        word = np.flatnonzero(marks)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(marks[word].view(np.int64))], ["word", "mark"])

    return run


def marks_of(wanted: DataFrame):
    """A broadcast bit map, of bounded size, of the ids in the one column of a table."""
    bits = 1 << min(max(16 * wanted.count(), 64).bit_length(), MOST_BITS.bit_length() - 1)
    marks = np.zeros(bits // 64, U)
    got = wanted.mapInArrow(_marks(bits), "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark")).toPandas()  # at most bits / 64 rows
    marks[got["word"].to_numpy(np.int64)] = got["mark"].to_numpy(np.int64).view(U)
    return wanted.sparkSession.sparkContext.broadcast(marks)


def marked(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which ids may be in the map; all that are wanted are."""
    at = _slot(ids, 64 * len(marks))
    return (marks[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def _only(marks):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(batch.column(1).to_numpy(), marks.value)))

    return run


def _buckets(window: int, count_bucket: Callable, most: int = 1 << 20):
    """Whole buckets of about most bytes at a time to (k, th, place) of the windows that repeat in them."""

    def settle(held):
        mh, k, th, places, packed = (np.concatenate([h[i] for h in held]) if i < 4 else [x for h in held for x in h[4]] for i in range(5))
        n = (places & 1023) + 1
        dup = count_bucket(mh, packed, n)  # for each window, in order, whether it repeats in its bucket
        if not dup.any():
            return None
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        edge = np.ones(len(row), bool)
        edge[1:] = (dup[1:] != dup[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(edge)
        length = np.diff(np.append(heads, len(row)))
        keep = dup[heads]
        heads, length = heads[keep], length[keep]
        r = row[heads]
        return pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(th[r]), pa.array(place((places[r] >> 10) + step[heads], length))], ["k", "th", "place"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            mh = batch.column(0).to_numpy()
            rows = (mh, *(batch.column(c).to_numpy() for c in (1, 2, 3)), batch.column(4).to_pylist())
            i = 0
            while i < len(mh):
                if size > most and held and held[-1][0][-1] != mh[i]:  # a boundary between buckets
                    if (out := settle(held)) is not None:
                        yield out
                    held, size = [], 0
                j = i
                while j < len(mh) and (size <= most or mh[j] == mh[max(j - 1, i)] and (j > i or not held or held[-1][0][-1] == mh[j])):
                    size += len(rows[4][j])
                    j += 1
                if j == i:
                    continue
                held.append(tuple(c[i:j] for c in rows))
                i = j
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _found(runs: DataFrame, hot: int) -> DataFrame:
    """(mh, k, th, place, copied, compare, hot) of the runs that are copies, or one of several kinds in their bucket."""
    spark = runs.sparkSession
    start = tables_written(spark)
    runs = materialize(runs)
    shared = materialize(runs.groupBy("mh").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("mh"))  # a table, so that AQE may split hot buckets in the join
    middle = tables_written(spark)
    alive = materialize(runs.join(shared, "mh"))
    drop_tables(spark, start, middle)
    copies = materialize(alive.groupBy("mh", "dg", "dg2").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("k", "th", "place")).alias("rep")))
    kinds = materialize(copies.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    known = alive.join(copies, ["mh", "dg", "dg2"]).join(kinds, "mh", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    one = (F.col("c") == 1) | (F.xxhash64("k", "th", "place") == F.col("rep"))
    known = known.select("mh", "k", "th", "place", (F.col("c") > 1).alias("copied"), ((F.col("kinds") > 1) & one).alias("compare"), (F.col("kinds") > hot).alias("hot"))
    end = tables_written(spark)
    found = materialize(known.where("copied or compare"))
    drop_tables(spark, start, end)
    return found


def repeated_windows(docs: DataFrame, unit: str, window: int, gram: int, count_bucket: Callable, hot: int = HOT, keep_rows: bool = False) -> DataFrame:
    """k, th, text (null as empty), spans (the repeated windows' (first, n), null if none) and, with keep_rows, docs' columns in struct ``row``."""
    if not 0 < gram <= window or window - gram >= 1024:
        raise ValueError("gram must be 1 to window, and less than 1024 under window")
    small_batches(docs.sparkSession)
    texts = keyed(docs).select("k", "th", "text")
    runs, parts = texts.mapInArrow(_scan(unit, window, gram), RUN), []
    grams = sorted({g for g in (window - max(1, window // 8), window) if g > gram})
    while True:
        found = _found(runs, hot if grams else 2**62)
        parts.append(found.where("copied").select("k", "th", "place"))

        def with_text(which, rows=texts):
            lists = found.where(which).groupBy("k", "th").agg(F.collect_set(F.struct("mh", "place")).alias("runs"))  # a set: repeated rows have the same places
            return rows.join(lists, ["k", "th"]).select("k", "th", "text", "runs")

        packed = with_text("compare and not hot").mapInArrow(_cut(unit, window), "mh long, k long, th long, place long, packed binary")
        parts.append(packed.repartition("mh").sortWithinPartitions("mh").mapInArrow(_buckets(window, count_bucket), "k long, th long, place long"))
        if not grams or not found.where("compare and hot").limit(1).count():
            break
        wanted = materialize(found.where("compare and hot").select("th").distinct())
        few = texts.mapInArrow(_only(marks_of(wanted)), "k long, th long, text string")  # other texts aren't sent again
        runs = with_text("compare and hot", few).mapInArrow(_rescan(unit, window, grams.pop(0)), RUN)
    parts = reduce(DataFrame.union, parts)
    spans = parts.groupBy("k", "th").agg(F.collect_set(F.struct(F.expr(FIRST).alias("first"), F.expr(COUNT).alias("n"))).alias("spans"))
    if not keep_rows:  # the same columns as above, so that one exchange of the texts serves both joins
        return texts.join(spans, ["k", "th"], "left")
    whole = docs.select(F.struct("*").alias("row")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("row.text", F.lit("")).alias("text"))
    return whole.withColumn("th", F.xxhash64("text")).join(spans, ["k", "th"], "left")


def covered(spans, n: int, window: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    if not spans:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["first"] for s in spans], 1)
    np.add.at(edge, [s["first"] + s["n"] - 1 + window for s in spans], -1)
    return np.cumsum(edge[:n]) > 0
