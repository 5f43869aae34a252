"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set is its distinct ``shingle``-word
shingles (64-bit hashes); with fewer words the whole sequence is the only one. Two documents are linked when
100 * |A & B| >= threshold * |A | B|, which is confirmed on the full sets.

1. One pass makes, of each text, the set's size and 128-bit digest and its band keys. One hash function puts each
   shingle in one of bands * rows bins and keeps the bin's minimum; each empty bin copies the first full bin of its
   own fixed random order (optimal densification), so that empty bins of two sets agree as often as full ones.
   At similarity 0.8, 32 bands of 5 rows miss a pair with probability 3e-6.
2. Equal sets (copies) are one node, whatever their number and ids, named by the hash of one of their texts.
3. A bucket of m nodes gives m - 1 candidates: its smallest node is the hub of a star. Hubs come from map-side
   minima and are joined back, so no task needs a whole bucket.
4. Candidates' sets are made from the texts again, in a pass that a bit map of the wanted nodes (of bounded size) lets
   skip most texts, and joined to the pairs. Texts themselves never travel.
5. Components come from alternating large-star and small-star rounds, each written to the shared folder.
6. A star can miss a link between two of its rays. The rays of buckets that still hold more than one component (of buckets
   with the same rays, one) are compared by their sets' sizes and by bit maps that grow with the sets, which bound the
   intersection from above: in blocks of about 32 * ``block`` words of maps, so that a task holds two blocks, and only
   pairs of different components that the bounds don't rule out are emitted. They're confirmed as in 4, and their links
   join components.

Null and empty texts have no set and are linked with nothing. doc_id names a document: repeated rows get the same
component, and an id with two texts has the links of both. A null doc_id names nothing: such rows are told apart by
their text. A component_id is the smallest doc_id of the component, null if all its rows have none; then the text with
the smallest hash is the one kept. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, slices, small_batches, table, text_buffer
from .repeats import STEP, Sums, marked, marks_of, mixed, word_units

SHINGLE, BANDS, ROWS, THRESHOLD = 4, 32, 5, 80
#: A set's bit map has 8 bits a shingle at least, in a power of two of 64-bit words, LEAST_WORDS at least.
LEAST_WORDS = 32
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and each text's range of them."""
    u, uoff = word_units(LOWER[raw], off)
    n = np.diff(uoff)
    size = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(size)])
    a = np.repeat(uoff[:-1] - soff[:-1], size) + np.arange(soff[-1])
    b = np.minimum(a + shingle, np.repeat(uoff[1:], size))
    h = mixed(Sums(u).of(a, b) + (b - a).astype(np.uint64), 6)
    for i, j in zip(soff[:-1].tolist(), soff[1:].tolist()):
        h[i:j].sort()
    text = np.repeat(np.arange(len(n)), size)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[soff]


@lru_cache(4)
def _orders(bins: int, tries: int) -> np.ndarray:
    """orders[t, i]: the bin that empty bin i looks at in try t."""
    at = np.arange(tries * bins, dtype=np.uint64)
    return (mixed(at, 21) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def sketches(h: np.ndarray, soff: np.ndarray, bins: int, tries: int = 400) -> np.ndarray:
    """(texts, bins) minima after densification; texts without shingles keep the empty mark."""
    empty = np.uint64(2**64 - 1)
    texts = len(soff) - 1
    m = mixed(h, 8)
    text = np.repeat(np.arange(texts), np.diff(soff))
    bin_ = ((m >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    s = np.full(texts * bins, empty)
    np.minimum.at(s, text * bins + bin_, mixed(m, 10) >> np.uint64(1))
    s = s.reshape(texts, bins)
    full = s != empty
    r, c = np.nonzero(~full & full.any(axis=1)[:, None])
    orders, out, t = _orders(bins, tries), s.copy(), 0
    while len(r):
        src = orders[t][c] if t < tries else (c + t) % bins  # after the random tries, the bins to the right
        hit = full[r, src]
        out[r[hit], c[hit]] = s[r[hit], src[hit]]
        r, c, t = r[~hit], c[~hit], t + 1
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(s), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mixed(key ^ mixed(s[:, i::rows][:, :bands], 13 + i), 30 + i)
    return key


def bit_maps(h: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit for each shingle, at its hash: the texts' maps one after another, and each map's range of words."""
    n = np.diff(soff)
    words = np.exp2(np.ceil(np.log2(np.maximum(n / 8, LEAST_WORDS)))).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(words)])
    at = (mixed(h, 50) & np.repeat(64 * words - 1, n).astype(np.uint64)).astype(np.int64)
    out = np.zeros(off[-1], np.uint64)
    np.bitwise_or.at(out, np.repeat(off[:-1], n) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64), off


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (sets, more words) as they'd be with so many words."""
    while maps.shape[1] > words:
        maps = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :]
    return maps


def may_be_near(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: int) -> np.ndarray:
    """For maps a, b of sets with na, nb shingles, whether each pair can be similar enough: a bit that only one map has
    is a shingle that only that set has, so this never rejects a similar pair."""
    both = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    only_a, only_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None] - both, np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :] - both
    common = np.minimum(na[:, None] - only_a, nb[None, :] - only_b)
    return (100 + threshold) * common >= threshold * (na[:, None] + nb[None, :])


def near_places(n: np.ndarray, root: np.ndarray, maps: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: int, step: int = 64, most: int = 1 << 21):
    """Pieces (p, q) of pairs of x and y in different components that their sizes and maps don't rule out."""
    words = np.array([len(m) for m in maps])
    for w in np.unique(words[x]):
        for v in (w // 2, w, 2 * w):  # similar sets' maps differ in size by a factor of 2 at most
            p_all, q_all = (i[words[i] == k] for i, k in ((x, w), (y, v)))
            if not len(p_all) or not len(q_all):
                continue
            p_all, q_all = p_all[np.argsort(n[p_all], kind="stable")], q_all[np.argsort(n[q_all], kind="stable")]
            a, b = (folded(np.stack([maps[i] for i in part]).view(np.uint64), min(v, w)) for part in (p_all, q_all))
            wide = max(1, most // (step * min(v, w)))
            for i in range(0, len(p_all), step):
                p = p_all[i : i + step]
                lo, hi = np.searchsorted(100 * n[q_all], threshold * n[p[0]], "left"), np.searchsorted(threshold * n[q_all], 100 * n[p[-1]], "right")
                for j in range(lo, hi, wide):
                    q = q_all[j : min(j + wide, hi)]
                    ok = may_be_near(a[i : i + step], n[p], b[j : j + len(q)], n[q], threshold) & (root[p][:, None] != root[q][None, :])
                    r, c = np.nonzero(ok)
                    yield p[r], q[c]


def _block_pairs(threshold):
    """Rows (key, lo, hi, block, node, n, root, bits), sorted by (key, lo, hi), to the pairs of nodes of block lo with
    nodes of block hi that lie in different components and may be near."""

    def settle(block, lo, hi, node, n, root, bits):
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        for p, q in near_places(n, root, bits, x, y, threshold):
            if lo == hi:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns[:7]]
            off = batch.column(7).offsets.to_numpy()
            flat = batch.column(7).flatten().to_numpy()
            maps = np.empty(len(off) - 1, object)
            maps[:] = [flat[i - off[0] : j - off[0]] for i, j in zip(off[:-1], off[1:])]
            cols.append(maps)
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            key, lo, hi = cols[:3]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])) if len(key) else np.zeros(0, np.int64)
            for i, j in zip(starts[:-1], starts[1:]):
                yield from settle(cols[3][i:j], lo[i], hi[i], *(c[i:j] for c in cols[4:]))
            held = [c[starts[-1] :] for c in cols] if len(starts) else None
        if held is not None and len(held[0]):
            yield from settle(held[3], held[1][0], held[2][0], *held[4:])

    return run


def _scan(shingle, bands, rows):
    def run(batches):
        for batch in batches:
            off, raw = text_buffer(batch.column(1))
            for i, j in slices(off, STEP):
                h, soff = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                for k in (0, 1):
                    np.cumsum(mixed(h, 40 + k), out=sums[k, 1:])
                d = [(sums[k][soff[1:]] - sums[k][soff[:-1]]).view(np.int64) for k in (0, 1)]
                keys = band_keys(sketches(h, soff, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                words, woff = bit_maps(h, soff)
                maps = pa.ListArray.from_arrays(pa.array(woff, pa.int32()), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(soff)), pa.array(d[0]), pa.array(d[1]), lists, maps], ["id", "th", "n", "d1", "d2", "bands", "bits"])

    return run


def _sets(shingle, marks):
    """(id, grams) of the marked ids, each once a task."""

    def run(batches):
        seen = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hit = marked(ids, marks.value)
            for i in np.flatnonzero(hit).tolist():
                hit[i] = ids[i] not in seen
                seen.add(ids[i])
            batch = batch.filter(pa.array(hit))
            off, raw = text_buffer(batch.column(1))
            for i, j in slices(off, STEP):
                h, soff = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                grams = pa.ListArray.from_arrays(pa.array(soff, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), grams], ["id", "grams"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough; texts: (id, text), where rows of one id have
    equal texts. No aggregate follows the joins, so that AQE may split a hub's rays."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(wanted)
    shared = marks_of(wanted)
    sets = materialize(texts.select("id", "text").mapInArrow(_sets(shingle, shared), "id long, grams array<long>").dropDuplicates(["id"]).join(wanted, "id"))
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("same"))
    return materialize(both.where(f"100L * same >= {threshold}L * (total - same)").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that aren't the smallest of their component; edges: (a, b)."""
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        inner = cur.join(cur.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if not inner and not cur.groupBy("u").count().where("count > 1").limit(1).count():  # stars around their smallest nodes
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # tables, so that AQE may split a hub's edges
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = materialize(small.distinct())


def _placed(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD, block: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, classes, roots): id, th, n, d1, d2 of each row; the node of each digest; the root of each node that is none."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    scanned = texts.mapInArrow(_scan(shingle, bands, rows), "id long, th long, n long, d1 long, d2 long, bands array<long>, bits array<long>")
    scanned = materialize(scanned.withColumn("at", F.monotonically_increasing_id()))
    texts = texts.select(F.col("th").alias("id"), "text")  # a node is found again by its text, which ids and their nulls don't name
    first = scanned.where("n > 0").groupBy("d1", "d2").agg(F.min("at").alias("at")).select("at")
    classes = materialize(scanned.select("at", "th", "d1", "d2").join(first, "at").select("d1", "d2", "at", F.col("th").alias("node")))
    nodes = scanned.select("at", "n", "bands", "bits").join(classes.select("at", "node"), "at")
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub")
    buckets = materialize(keys.join(materialize(shared), "key").select("key", "hub", "node", "n").distinct())
    done = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(materialize(done), texts, shingle, threshold)
    roots = components(links)
    placed = buckets.where("node <> hub").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    work = F.sum(F.greatest(F.col("n") / 4, F.lit(LEAST_WORDS)))  # words of the bucket's maps, at most
    alike = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m"), work.alias("work"), *alike).where("r0 <> r1")
    split = split.groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.max("work").alias("work")).select("key", "work")  # of buckets with the same nodes, one
    left = placed.join(materialize(split), "key").withColumn("blocks", F.ceil(F.col("work") / (32 * block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.join(nodes.select("node", "bits"), "node")
    left = left.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "root", "bits")
    pairs = left.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_block_pairs(threshold), "a long, b long").distinct()
    pairs = materialize(pairs)
    if pairs.limit(1).count():
        new = confirm(pairs, texts, shingle, threshold)
        if new.limit(1).count():
            up = lambda side: F.coalesce(F.col(f"r{side}"), F.col(side)).alias(side)
            ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            higher = components(new.join(ra, "a", "left").join(rb, "b", "left").select(up("a"), up("b")))
            above = higher.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(higher)
    return scanned, classes.select("d1", "d2", "node"), roots


def _components(docs: DataFrame, *parameters) -> DataFrame:
    """One row a row of docs: doc_id, th (the text's hash), n_shingles, component_id, kept."""
    scanned, classes, roots = _placed(docs, *parameters)
    found = scanned.where("n > 0").select("id", "th", "n", "d1", "d2").join(classes, ["d1", "d2"]).join(roots, "node", "left")
    found = materialize(found.select("id", "th", "n", F.coalesce("root", "node").alias("root")))
    several = materialize(found.where("id is not null").groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("id", "a"))
    if several.limit(1).count():  # one document with different texts joins their components
        higher = components(found.join(several, "id").select("a", F.col("root").alias("b")))
        found = found.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        found = materialize(found.select("id", "th", "n", F.coalesce("top", "root").alias("root")))
    least = materialize(found.groupBy("root").agg(F.min("id").alias("component_id"), F.min("th").alias("first")))
    kept = F.when(F.col("component_id").isNull(), F.col("th") == F.col("first")).otherwise(F.col("id").eqNullSafe(F.col("component_id")))
    found = found.join(least, "root").select("id", "th", "n", "component_id", kept.alias("kept"))
    alone = scanned.where("n = 0").select("id", "th", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone).select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), "component_id", "kept")


def near_components(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD, block: int = 2048) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept."""
    return _components(docs, shingle, bands, rows, threshold, block).drop("th")


def representatives(docs: DataFrame, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD, block: int = 2048) -> DataFrame:
    """docs without the rows that aren't kept; of repeated rows that would stay, one does."""
    found = materialize(_components(docs, shingle, bands, rows, threshold, block))
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone_doc_id"), F.col("th").alias("__gone_th")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__gone_doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__gone_th"])
    kept = docs.join(gone, same, "left_anti")
    repeated = found.where("kept").groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
