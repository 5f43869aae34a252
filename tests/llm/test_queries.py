"""The registered queries on a small folder with nulls, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from sigmill.llm.pow2_packing import Encoder, vocabulary_path
from sigmill.llm.queries import QUERIES
from sigmill.llm.warc_derivatives import text_of
from test_minhash import brute as near
from test_repeats import brute as repeats


@pytest.fixture(scope="module")
def folder(odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    odd_docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_near_dedup(spark, folder, rows):
    got = QUERIES["op3_minhash_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near(rows, 4, 80)


def test_repeats_of_words_and_bytes(spark, folder, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_superkmer_dedup"](spark, folder).collect())
    assert got == Counter((i, a, b, d) for (i, _), (a, b, _, d) in zip(rows, repeats([t for _, t in rows], bytes.split, b" ".join, 35)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, folder).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, repeats([t for _, t in rows], lambda b: b, bytes, 400)))


def test_packing(spark, folder, rows):
    encode = Encoder(vocabulary_path()).whole
    whole = Counter()
    for i, t in rows:
        ids = (encode(t) if t else b"") + b"\0\0\0\0"
        n, start = len(ids) // 4, 0
        while start < n:
            size = min(1024, 1 << (n - start).bit_length() - 1)
            whole[i, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n] += 1
            start += size
    got = QUERIES["op6_pow2_packing"](spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == whole
    assert all(r.offset == 0 for r in got) and len({r.sequence_id for r in got}) == len(got)


def test_media(spark, folder, rows):
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    got = QUERIES["op9_mjpeg_media"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    seen = defaultdict(set)
    for r in got:
        seen[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature, str(r.clips)))
        frames = r.payload_bytes // 192
        assert r.clips[0].first_frame == 0 and sum(c.frames for c in r.clips) == frames and abs(r.clips[-1].end_s - frames / 25) < 1e-6
    assert all(len(v) == 1 for v in seen.values())


class Plain(HTMLParser):
    """Visible text by a tokenizer, for pages whose elements are all closed."""

    BREAKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
    HIDDEN = {"head", "script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def text(self, page):
        self.feed(page)
        self.close()
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_page_texts_equal_a_tokenizer(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += ["<html><head><title>T</title></head><body><div>a<b>b</b> c<br/>d &amp; e&nbsp;f</div><script>x<y</script><p>g</p></body></html>", "<p>one</p><!-- <p>no</p> --><ul><li>x<li>y</ul>", "<style>p{}</style>text <em class='a>b'>kept</em>", '<p title="x>y">in</p> <a href=\'q>"\'>link</a>', "<p>5 o'clock <b>it's</b></p>"]
    assert len(pages) > 20
    for page in pages:
        if page is not None:
            assert text_of(page).split() == Plain().text(page).split()
    odd = "<html><head><title>T</title><body><p>Real text</p></body></html>"
    assert text_of(odd) == "Real text"
