import random
from collections import Counter, defaultdict

import numpy as np

from sigmill.llm.minhash_dedup import band_keys, bit_maps, near_components, near_places, representatives, shingle_sets, sketches

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, threshold):
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= threshold * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)), key=lambda v: (v is None, v))
                parent[y] = x
    return Counter((i, len(s), find(i) if s else i) for i, s in sets)


def families(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(6):
        base = [r.choice(words) for _ in range(100)]
        for _ in range(20):
            cur = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                cur[r.randrange(len(cur))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(cur)))
            if f % 2 and r.random() < 0.5:  # chains that drift away
                base = cur
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k in (4, 5):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_components(odd_docs, k).collect())
        assert got == brute(rows, k, 80)


def test_chains_and_stars(spark):
    rows, docs = families(spark)
    got = near_components(docs, block=7).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_group_stays(odd_docs):
    out = representatives(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd_docs.columns and len(set(ids)) == len(ids)
    assert 1 in ids and not {2, 3} & set(ids) and {4, 5, 6} <= set(ids)


def test_rows_without_id_are_told_apart_by_text(spark):
    r = random.Random(5)
    fresh = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]

    def near(words):
        return " ".join([*words[:50], "other", *words[51:]])

    a, x, y, z, p, q = (fresh() for _ in range(6))
    join = " ".join
    rows = [(1, join(a)), (None, near(a)), (None, join(x)), (None, join(y)), (None, near(y)), (None, join(z)), (None, join(z)), (None, ""), (2, join(p)), (2, join(q)), (3, near(q)), (4, near(p))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((g.doc_id, g.component_id, g.kept) for g in near_components(docs, 5).collect())
    assert got == Counter({(1, 1, True): 1, (None, 1, False): 1, (None, None, True): 5, (None, None, False): 1, (2, 2, True): 2, (3, 2, False): 1, (4, 2, False): 1})
    left = Counter(tuple(g) for g in representatives(docs).collect())
    one = (left.keys() & {(None, join(y)), (None, near(y))}).pop()
    assert left == Counter([(1, join(a)), (None, join(x)), one, (None, join(z)), (None, ""), (2, join(p)), (2, join(q))])


def test_empty_table(no_docs):
    assert near_components(no_docs).count() == 0


def test_bins_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        n = int(rng.integers(20, 400))
        words = [f"{x}" for x in rng.integers(0, 10**9, n + 200)]
        a, b = " ".join(words[: n + 100]).encode(), " ".join(words[100 : n + 200]).encode()
        raw, off = np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)])
        h, soff = shingle_sets(raw, off, 1)
        s = sketches(h, soff, 160)
        same.append((s[0] == s[1]).mean() - n / (n + 200))
        assert band_keys(s, 32, 5).shape == (2, 32)
    assert abs(np.mean(same)) < 0.02


def test_maps_rule_out_long_sets_and_never_a_similar_pair():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 40, 500, 4000, 4000, 30000):
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [own, np.concatenate([own[: max(1, int(n * 0.9))], rng.integers(0, 2**63, n // 10).astype(np.uint64)])]
    words, off = bit_maps(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    maps = [words[i:j] for i, j in zip(off[:-1], off[1:])]
    n, every = np.array([len(s) for s in sets]), np.arange(len(sets))
    got = {(a, b) for p, q in near_places(n, every, maps, every, every, 80, 3, 64) for a, b in zip(p.tolist(), q.tolist())}
    near = {(a, b) for a in every.tolist() for b in every.tolist() if a != b and 100 * len(i := np.intersect1d(sets[a], sets[b])) >= 80 * (n[a] + n[b] - len(i))}
    assert near <= got and {(2 * i, 2 * i + 1) for i in range(1, 6)} <= near
    assert not {(a, b) for a, b in got if a // 2 != b // 2}


def test_recall_on_near_copies_of_long_texts(spark):
    r = random.Random(11)
    rows = []
    for f in range(5):
        base = [f"w{r.randrange(4000)}" for _ in range(2500)]
        for _ in range(8):
            cur = list(base)
            for _ in range(r.randrange(20, 110)):
                cur[r.randrange(len(cur))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(cur)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((g.doc_id, g.n_shingles, g.component_id) for g in near_components(docs).collect())
    assert got == brute(rows, 4, 80)
