"""AVI motion-JPEG columns: lossless storage of byte payloads, RIFF parsing, intra decoding and shot detection.

Writing. A payload of 8-bit samples is cut into frames of 16 x 12 samples. Each sample is the mean of one 8 x 8
block of a grayscale baseline JPEG: with DC step 8 the stored DC level is sample - 128 exactly and all AC terms
are 0, so every decoder gives the sample back in all 64 pixels of its block. DC differences lie in -255..255; a
Huffman table in which category c has a code of 9 - c bits makes each difference 9 bits, and the end-of-block
code is 1 bit, so that a frame's scan is packed and unpacked by array operations. The frames go into an AVI file
(RIFF, hdrl, movi with 00dc chunks, idx1).

Reading. The RIFF tree is walked, frames are found by idx1 and checked against their chunk headers, and each
JPEG's tables are parsed. Scans whose tables have the constant-length property are decoded by array operations,
any other single-component baseline scan by a bit-wise Huffman decoder with inverse DCT (block means).

Shots. Frames' 16-bin sample histograms are compared with the frame before; a cut is where the L1 difference
exceeds the other differences within 8 frames on each side, their median + 2 standard deviations (1.4826 times the
median absolute deviation), and reaches a floor of a quarter of the samples. With fewer than 8 others, as in clips of
9 frames or fewer, the floor alone decides. Cuts don't hide each other while fewer than half of the differences in a
window are cuts; where more are as large, it counts as motion. Clips are the runs between cuts, timed at the file's
frame rate.

Null and empty payloads are 192 spaces, one frame. Work is row by row, no shuffle; memory follows the longest
payload, and an AVI of over 4 GB, which its 32-bit sizes can't state, is an error. Repeated rows give equal rows. An empty
table gives an empty result. Damaged files raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, small_batches, table, text_buffer

ACROSS, DOWN = 16, 12
UNIT = ACROSS * DOWN
RATE = 25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def _jpeg_head() -> bytes:
    steps = bytes([8]) * 64
    dc_lengths = [0] * 16
    for category in range(9):
        dc_lengths[9 - category - 1] += 1
    dc = bytes([0x00]) + bytes(dc_lengths) + bytes(range(8, -1, -1))  # shortest code first: category 8
    ac = bytes([0x10, 1]) + bytes(15) + b"\x00"
    frame = struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, b"\0" + steps) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


@lru_cache(1)
def _dc_words() -> np.ndarray:
    """The 10 bits (code, extra bits, end of block) of each difference -255..255, at difference + 255."""
    words = np.zeros(511, np.uint16)
    code = 0
    for length in range(1, 10):
        category = 9 - length
        for v in range(-(1 << category) + 1, 1 << category):
            if abs(v).bit_length() == category:
                extra = v if v >= 0 else v + (1 << category) - 1
                words[v + 255] = ((code << category) | extra) << 1
        code = (code + 1) << 1
    return words


def encode_scans(samples: np.ndarray) -> np.ndarray:
    """(frames, 240) bytes before stuffing, from (frames, 192) samples."""
    level = samples.astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    words = _dc_words()[diff + 255].reshape(-1, 4).astype(np.uint64)
    packed = words[:, 0] << np.uint64(30) | words[:, 1] << np.uint64(20) | words[:, 2] << np.uint64(10) | words[:, 3]
    out = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return out.reshape(len(samples), UNIT * 10 // 8)


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of 192 bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    scans = encode_scans(samples).tobytes()
    head, size = _jpeg_head(), UNIT * 10 // 8
    parts, index, at, largest = [], [], 4, 0
    for i in range(len(samples)):
        jpeg = head + scans[i * size : (i + 1) * size].replace(b"\xff", b"\xff\0") + b"\xff\xd9"
        n = len(jpeg)
        parts.append(struct.pack("<4sI", b"00dc", n) + jpeg + b"\0" * (n & 1))
        index.append((at, n))
        at += 8 + n + (n & 1)
        largest = max(largest, n)
    entries = np.zeros(len(index), [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    entries["id"], entries["flags"] = b"00dc", 0x10
    entries["at"], entries["size"] = np.array(index, np.uint32).T
    movi = b"movi" + b"".join(parts)
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, len(samples), 0, 1, largest, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(samples), largest, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    kind = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 8, b"MJPG", ACROSS * DOWN * 64, 0, 0, 0, 0)
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) & 1)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", kind)))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", movi) + chunk(b"idx1", entries.tobytes()))


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise ValueError("a RIFF chunk runs past its parent")
        yield name, at + 8, n
        at += 8 + n + (n & 1)


def parse_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame and (offset, size) of each frame's JPEG, in the order of idx1."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    pace, movi, index = 1.0 / RATE, None, None
    for name, at, n in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for sub, a, _ in _chunks(data, at + 4, at + n):
                if sub == b"avih":
                    pace = int.from_bytes(data[a : a + 4], "little") / 1e6
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, n)
        elif name == b"idx1":
            index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], n // 16, at)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return pace, [(a, n) for name, a, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]
    mine = index[(index["id"] == b"00dc") | (index["id"] == b"00db")]
    base = movi[0] if not len(mine) or data[movi[0] + int(mine["at"][0]) : movi[0] + int(mine["at"][0]) + 4] == mine["id"][0] else 0
    found = []
    for at, n in zip(mine["at"].tolist(), mine["size"].tolist()):
        at += base
        if int.from_bytes(data[at + 4 : at + 8], "little") != n or at + 8 + n > len(data):
            raise ValueError("idx1 and a chunk header disagree")
        found.append((at + 8, n))
    return pace, found


@lru_cache(64)
def _tables(head: bytes) -> dict:
    """What a JPEG's segments up to its scan say."""
    out, at = {"huff": {}, "quant": {}}, 2
    while at < len(head):
        marker, n = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(int)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            if body[5] != 1:
                raise ValueError("only single-component frames are read")
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "tq": body[8]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                lengths, symbols, code, codes = body[1:17], body[17 : 17 + sum(body[1:17])], 0, {}
                it = iter(symbols)
                for length, count in enumerate(lengths, 1):
                    for _ in range(count):
                        codes[length, code] = next(it)
                        code += 1
                    code <<= 1
                out["huff"][body[0]] = codes
                body = body[17 + len(symbols) :]
        elif marker == 0xDD:
            raise ValueError("restart intervals aren't read")
        elif marker == 0xDA:
            out |= {"dc": body[2] >> 4, "ac": 0x10 | body[2] & 15}
        at += 2 + n
    dc, ac = out["huff"][out["dc"]], out["huff"][out["ac"]]
    out["step"] = int(out["quant"][out["tq"]][0])
    out["blocks"] = -(-out["width"] // 8) * -(-out["height"] // 8)
    out["constant"] = {length + s for (length, _), s in dc.items()} == {9} and ac == {(1, 0): 0} and out["blocks"] == UNIT and out["step"] == 8
    if out["constant"]:
        back = np.zeros(512, np.int16)
        for (length, code), s in dc.items():
            for extra in range(1 << s):
                back[code << s | extra] = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
        out["back"] = back
    return out


def _slow_scan(t: dict, scan: bytes) -> np.ndarray:
    """Block means of any single-component baseline scan."""
    bits, at, mean, pred = int.from_bytes(scan, "big"), 8 * len(scan), [], 0

    def take(n):
        nonlocal at
        at -= n
        if at < 0:
            raise ValueError("the scan is cut short")
        return (bits >> at) & ((1 << n) - 1)

    def symbol(codes):
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("not a code of the table")

    for _ in range(t["blocks"]):
        s = symbol(t["huff"][t["dc"]])
        v = take(s) if s else 0
        pred += v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
        k = 1
        while k < 64:  # AC terms don't change a block's mean
            rs = symbol(t["huff"][t["ac"]])
            if rs == 0:
                break
            k += (rs >> 4) + 1
            take(rs & 15)
        mean.append(pred)
    return np.clip(np.round(np.array(mean) * t["step"] / 8 + 128), 0, 255).astype(np.uint8)


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """The block means (samples) of each frame."""
    scans, slow = [], {}
    for i, jpeg in enumerate(jpegs):
        at = jpeg.index(b"\xff\xda")
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        t = _tables(jpeg[:at])
        if jpeg[-2:] != b"\xff\xd9":
            raise ValueError("a frame has no end marker")
        scan = jpeg[at:-2].replace(b"\xff\0", b"\xff")
        if t["constant"]:
            if len(scan) != UNIT * 10 // 8:
                raise ValueError("the scan has the wrong length")
            scans.append(scan)
        else:
            slow[i] = _slow_scan(t, scan)
    fast = np.zeros((0, UNIT), np.uint8)
    if scans:
        raw = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5)
        packed = np.zeros((len(raw), 8), np.uint8)
        packed[:, 3:] = raw
        word = packed.reshape(-1).view(">u8").astype(np.uint64)
        codes = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).reshape(len(scans), UNIT)
        back = next(t for t in [_tables(j[: j.index(b"\xff\xda") + 2 + int.from_bytes(j[j.index(b"\xff\xda") + 2 : j.index(b"\xff\xda") + 4], "big")]) for j in jpegs] if t["constant"])["back"]
        fast = (np.cumsum(back[(codes >> np.uint64(1)).astype(np.intp)], axis=1, dtype=np.int16) + 128).astype(np.uint8)
    if not slow:
        return list(fast)
    it = iter(fast)
    return [slow[i] if i in slow else next(it) for i in range(len(jpegs))]


def _medians(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The median of the count smallest values of each row."""
    x = np.sort(x, axis=1)
    row = np.arange(len(x))
    return (x[row, (count - 1) // 2] + x[row, count // 2]) / 2


def shot_cuts(frames: np.ndarray, radius: int = 8) -> np.ndarray:
    """Indices of frames that begin a shot (0 among them)."""
    n = len(frames)
    counts = np.bincount((np.arange(n)[:, None] * 16 + (frames >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    if n == 1:
        return np.zeros(1, np.int64)
    d = np.abs(np.diff(counts, axis=0)).sum(axis=1).astype(float)
    at = np.flatnonzero(d >= frames.shape[1] / 4)
    others = np.minimum(at, radius) + np.minimum(n - 2 - at, radius)
    many = others >= radius
    near, count = at[many], others[many]
    edge = np.full(radius, np.inf)  # sorts behind the others and isn't counted
    window = np.concatenate([edge, d, edge])[near[:, None] + np.delete(np.arange(2 * radius + 1), radius)]
    m = _medians(window, count)
    sd = 1.4826 * _medians(np.abs(window - m[:, None]), count)
    cut = np.ones(len(at), bool)
    cut[many] = d[near] > m + 2 * sd
    return np.concatenate([[0], at[cut] + 1])


def read_payload(avi: bytes) -> tuple[bytes, float, np.ndarray]:
    """The stored samples, seconds a frame, and the shots' first frames."""
    pace, at = parse_avi(avi)
    frames = np.array(decode_frames([avi[a : a + n] for a, n in at]))
    return frames.tobytes(), pace, shot_cuts(frames)


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the AVI file of the text's padded UTF-8 bytes."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            off, raw = text_buffer(batch.column(1))
            data = raw.tobytes()
            for i, j in slices(off, 1 << 22):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([write_avi(pad(data[off[r] : off[r + 1]])) for r in range(i, j)], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, media binary")


CLIP = ("clip", "first_frame", "frames", "start_s", "end_s")
CLIP_TYPE = "clip: bigint, first_frame: bigint, frames: bigint, start_s: double, end_s: double"


def _clip_rows(cuts: np.ndarray, frames: int, pace: float) -> list[tuple]:
    """One row, as of CLIP, for each shot."""
    ends = np.append(cuts[1:], frames)
    return list(zip(range(len(cuts)), cuts.tolist(), (ends - cuts).tolist(), (cuts * pace).tolist(), (ends * pace).tolist()))


def clips(media: DataFrame) -> DataFrame:
    """One row a shot of each AVI in column media: doc_id, clip, first_frame, frames, start_s, end_s."""

    def run(batches):
        for batch in batches:
            for doc_id, avi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if avi is None:
                    continue
                payload, pace, cuts = read_payload(avi)
                rows = list(zip(*_clip_rows(cuts, len(payload) // UNIT, pace)))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(cuts), pa.int64()), *(pa.array(c) for c in rows)], ["doc_id", *CLIP])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, " + CLIP_TYPE)


def _digest(raw: bytes) -> tuple:
    avi = write_avi(pad(raw))
    payload, pace, cuts = read_payload(avi)
    frames = np.frombuffer(payload, np.uint8)
    marks = zlib.crc32(cuts.astype("<i8").tobytes())
    feature = f"frames={len(payload) // UNIT};shots={len(cuts)};longest={int(np.diff(np.append(cuts, len(payload) // UNIT)).max())};cuts={marks:08x};mean={frames.mean():.6f};seconds={len(payload) // UNIT * pace:.2f}"
    rows = [dict(zip(CLIP, c)) for c in _clip_rows(cuts, len(payload) // UNIT, pace)]
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature, rows


def media_digests(docs: DataFrame) -> DataFrame:
    """Write each text's AVI, read it back, and return the digests of what was read, and its shots as timed clips."""
    small_batches(docs.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.struct([(c, pa.float64() if c.endswith("_s") else pa.int64()) for c in CLIP])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]

    def run(batches):
        for batch in batches:
            off, raw = text_buffer(batch.column(1))
            data = raw.tobytes()
            for i in range(0, batch.num_rows, 500):
                j = min(i + 500, batch.num_rows)
                rows = [_digest(data[off[r] : off[r + 1]]) for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<" + CLIP_TYPE + ">>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)


def op9_mjpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
