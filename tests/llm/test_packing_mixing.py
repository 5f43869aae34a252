import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sigmill.llm.poisson_mix import OP7_SQL, op7_poisson_mix, poisson_mix
from sigmill.llm.pow2_packing import Encoder, pow2_packing, vocabulary_path


def test_encoder_equals_the_tokenizer():
    enc, r = Encoder(vocabulary_path(), most=50), random.Random(1)
    assert enc.cut
    for x in ["", "  a  b", "it's\n\n  x\t\ty 12.5!!  ", "é　中文 x", "a<|endoftext|>b", "'''s 's", "a\n'd e", "\x85 a b"]:
        assert enc(x) == enc.whole(x)
    for _ in range(3000):
        x = "".join(r.choice(["a", "'s", "'", "12", "!", "é", " ", "\n", "B", "²", "º", "x", ".", "'ll", " a", "\nq"]) for _ in range(r.randrange(12)))
        assert enc(x) == enc.whole(x)


def test_pieces_tile_each_document(odd_docs, no_docs):
    enc = Encoder(vocabulary_path())
    got = defaultdict(list)
    for p in pow2_packing(odd_docs, keep_ids=True).collect():
        assert p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0 and p.bucket == p.length.bit_length() - 1
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32
        got[p.doc_id].append(p)
    whole = Counter((r.doc_id, (enc.whole(r.text) if r.text else b"") + b"\0\0\0\0") for r in odd_docs.collect())
    for doc_id, pieces in got.items():
        if doc_id in (None, 40):
            continue
        pieces.sort(key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in pieces)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert (doc_id, ids) in whole and pieces[0].doc_tokens == len(ids) // 4
    ids = [p.sequence_id for v in got.values() for p in v]
    assert len(ids) == len(set(ids)) and min(ids) >= 0
    assert pow2_packing(no_docs).count() == 0
    with pytest.raises(ValueError):
        pow2_packing(no_docs, length=1000)


def test_mean_repetition_and_determinism(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 2) end as source", "5L as n_chars")
    a = poisson_mix(docs, {"hot": 1.0, "s0": 4.0, "s1": 1.0})
    rows = a.collect()
    assert rows == poisson_mix(docs.repartition(7), {"hot": 1.0, "s0": 4.0, "s1": 1.0}).orderBy("shuffle_key").collect() or Counter((r.doc_id, r["copy"]) for r in rows) == Counter((r.doc_id, r["copy"]) for r in poisson_mix(docs.repartition(7), {"hot": 1.0, "s0": 4.0, "s1": 1.0}).collect())
    share = Counter(r.source for r in rows)
    assert abs(share["s0"] / len(rows) - 4 / 6) < 0.03 and None not in share and abs(len(rows) / 6000 - 1) < 0.06
    n = Counter((r.doc_id for r in rows if r.source == "s0"))
    rate = next(r.rate for r in rows if r.source == "s0")
    counts = Counter(n.values())
    total = docs.where("source = 's0'").count()
    assert abs((total - len(n)) / total - np.exp(-rate)) < 0.03 and abs(counts[2] / total - np.exp(-rate) * rate**2 / 2) < 0.03


def test_high_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, source string").union(spark.range(10, 1010).selectExpr("id", "'b'"))
    got = Counter(r.source for r in poisson_mix(docs, {"a": 2.0, "b": 0.0}, epochs=2.0).collect())
    assert set(got) == {"a"} and abs(got["a"] / 2004 - 1) < 0.1


def test_odd_rows_and_join_path(odd_docs, no_docs):
    a, b = poisson_mix(odd_docs), poisson_mix(odd_docs, most_sources=0)
    key = lambda df: Counter((r.doc_id, r.text, r["copy"]) for r in df.collect())
    assert key(a) == key(b) and set(odd_docs.columns) < set(a.columns)
    assert poisson_mix(no_docs).count() == 0 and poisson_mix(odd_docs, {}).count() == 0


def test_sql_and_query_agree_on_odd_rows(spark, odd_docs, tmp_path):
    more = spark.createDataFrame([(None, f"text {i % 2500}", "en", f"s{i % 3}" if i % 4 else None, 9) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").union(more).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, op7_poisson_mix(spark, str(tmp_path)).collect()))
    duckdb.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duckdb.sql(OP7_SQL).fetchall())
    keys = {r[-1] for r in got if r[0] is None}
    assert len(keys) > 1500 and abs(sum(got.values()) / 4050 - 1) < 0.1
