import hashlib
import gzip
import random
import zlib

import numpy as np
import pytest

from sigmill.llm import mjpeg_media as M, warc_derivatives as W


def test_lossless_round_trip():
    r = random.Random(0)
    for raw in [b"", b"a", bytes(range(256)) * 3, b"\xff" * 400, b"\0\xff" * 500, bytes(r.randrange(256) for _ in range(5000))]:
        padded = M.pad(raw)
        assert len(padded) % 192 == 0 and padded.startswith(raw) and len(padded) > 0
        payload, pace, cuts = M.read_payload(M.write_avi(padded))
        assert payload == padded and pace == 0.04 and cuts[0] == 0


def test_bitwise_decoder_agrees():
    avi = M.write_avi(M.pad(bytes(range(256)) * 2))
    for at, n in M.parse_avi(avi)[1]:
        jpeg = avi[at : at + n]
        end = jpeg.index(b"\xff\xda")
        end += 2 + int.from_bytes(jpeg[end + 2 : end + 4], "big")
        t = M._tables(jpeg[:end])
        assert (M._slow_scan(t, jpeg[end:-2].replace(b"\xff\0", b"\xff")) == M.decode_frames([jpeg])[0]).all()


def test_damage_is_an_error():
    avi = M.write_avi(M.pad(b"x" * 500))
    for bad in (b"", b"RIFF", avi[:40], avi[: len(avi) // 2]):
        with pytest.raises(ValueError):
            M.read_payload(bad)


def test_shots_at_changes():
    frames = np.concatenate([np.full((20, 192), 10), np.full((15, 192), 200), np.full((10, 192), 90)]).astype(np.uint8)
    assert M.shot_cuts(frames).tolist() == [0, 20, 35]


def test_shots_of_short_and_fast_clips():
    def cuts(*shots):
        return M.shot_cuts(np.concatenate([np.full((n, 192), v) for n, v in shots]).astype(np.uint8)).tolist()

    assert cuts((1, 0), (1, 255)) == [0, 1] and cuts((2, 7)) == [0]
    assert cuts((1, 0), (1, 255), (1, 0)) == [0, 1, 2] and cuts((3, 0), (3, 255)) == [0, 3]
    assert cuts((10, 0), (4, 255), (4, 0), (4, 255), (10, 0)) == [0, 10, 14, 18, 22]
    assert cuts((10, 0), (2, 255), (2, 0), (2, 255), (2, 0), (2, 255), (10, 0)) == [0, 10, 12, 14, 16, 18, 20]
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (200, 192)).astype(np.uint8)
    for cut in (1, 60, 199):  # also where the window is cut off by the clip's ends
        both = np.concatenate([noise[:cut] // 16, noise[cut:]])
        assert cut in M.shot_cuts(both).tolist()
    d = np.abs(np.diff([np.bincount(f >> 4, minlength=16) for f in noise], axis=0)).sum(axis=1)
    want = [0]
    for i in range(199):  # one at a time
        w = np.delete(d[max(0, i - 8) : i + 9], min(i, 8))
        if d[i] >= 48 and d[i] > np.median(w) + 2 * 1.4826 * np.median(np.abs(w - np.median(w))):
            want.append(i + 1)
    assert M.shot_cuts(noise).tolist() == want


def test_query_digests_and_clips(odd_docs, no_docs):
    got = M.media_digests(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id is not null").collect()}
    by = {}
    for r in got:
        if r.doc_id is not None:
            p = M.pad(texts[r.doc_id].encode())
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            assert by.setdefault(texts[r.doc_id], (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    clips = M.clips(M.store_media(odd_docs.where("doc_id = 20"))).orderBy("clip").collect()
    assert clips[0].first_frame == 0 and sum(c.frames for c in clips) == len(M.pad(texts[20].encode())) // 192
    digested = next(r for r in got if r.doc_id == 20)
    assert [tuple(c) for c in digested.clips] == [tuple(c)[1:] for c in clips] and f"shots={len(clips)};" in digested.feature
    assert M.media_digests(no_docs).count() == 0


def pages(spark):
    rows = [(1, "http://a/b", "<html><head><title>T</title></head><body><p>One &amp; two<script>no</script><br>three</p><!-- x --></body></html>"), (2, None, None), (None, "http://c\r\nX: y", ""), (3, "http://d", "<p>é" * 5000), (1, "http://a/b", "<p>again"), (4, "u", "a < b > c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_records_are_linked(spark):
    made = W.derivatives(W.responses(pages(spark))).collect()
    assert len(made) == 12
    sources = {}
    for r in W.responses(pages(spark)).collect():
        headers, block, n = W.parse_record(bytes(r.record))
        assert n == len(r.record)
        h = dict(headers)
        assert W.digest(block) == h["WARC-Block-Digest"] and "X" not in h
        sources[h["WARC-Record-ID"]] = h
    for r in made:
        headers, block, _ = W.parse_record(bytes(r.record))
        h = dict(headers)
        assert h["WARC-Refers-To"] == r.refers_to and r.refers_to in sources
        assert h["WARC-Block-Digest"] == W.digest(block) == r.block_digest and r.content_length == len(block)
        assert r.payload_digest_holds and r.source_payload_digest == sources[r.refers_to]["WARC-Payload-Digest"]
        if r.kind == "conversion":
            assert block.decode() == r.text
        else:
            fields = dict(W._fields(block))
            assert fields["source.WARC-Record-ID"] == r.refers_to and fields["source.http.Content-Type"].startswith("text/html")
    one = next(r for r in made if r.kind == "conversion" and r.page_id == 1 and "One" in r.text)
    assert one.text == "One & two\nthree"


def test_a_head_without_end_tag():
    assert W.text_of("<html><head><title>T</title><body><p>text") == "text"
    assert W.text_of("<HEAD lang=en>\n<meta charset=utf-8><!-- <body> --><script>'<p>'</script><style>p {}</style><link rel=x>\n<p>one<p>two") == "one\ntwo"
    assert W.text_of("<head><title>T</title>bare text</html>") == "bare text"
    assert W.text_of("<head><title>T</title><body>one</head>two") == "onetwo"
    assert W.text_of("<head><script>'<body>'</script><title>T</title></head><body>text") == "text"
    assert W.text_of("<head><title>T</title></head><header>h</header><p>text") == "h\ntext"
    assert W.text_of("<head><title>T</title><script>var a") == "" == W.text_of("<style>p {}<p>text")


def test_files_and_damage(spark):
    recs = [bytes(r.record) for r in W.responses(pages(spark)).collect()]
    assert list(W.split_records(b"".join(recs))) == recs
    assert list(W.split_records(b"".join(gzip.compress(x) for x in recs))) == recs
    files = spark.createDataFrame([("p", bytearray(b"".join(recs)))], "path string, content binary")
    assert W.records(files).count() == len(recs)
    assert W.derive(recs[0][:-200])[0][0] == "error" and W.derive(b"junk")[0][0] == "error"
    assert W.derive(recs[0].replace(b"WARC-Type: response", b"WARC-Type: warcinfo")) == []
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.derivatives(W.responses(empty)).count() == 0
