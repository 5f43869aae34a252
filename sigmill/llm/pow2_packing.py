"""Packing by power-of-two decomposition.

A document is its token ids and one closing id 0. It's cut into pieces of 1024 while they fit, then into the
binary digits of what is left, largest first: 1500 ids give 1024, 256, 128, 64, 16, 8 and 4. Each piece is a
sequence of its own in the bucket of its length, so no sequence crosses documents and none needs padding.

A sequence_id is bucket << 59 | partition << 33 | number within (bucket, partition). It needs no shuffle and no
second pass over the texts; ids are unique over the result and gapless within a bucket of a partition.

Tokens come from a vocabulary file given by path. Words repeat, so each worker keeps a bounded table from word to
ids, filled through tiktoken with the same vocabulary (four times as fast on single words; a probe text and the
tests compare the two). Texts with characters outside Latin blocks, uneven white space or a special token's string are encoded
whole by the tokenizer, since only there could cutting first differ from the tokenizer's own cutting.

Null and empty texts are one piece with id 0. Repeated rows are packed once each. An empty table gives an empty
result. A document of any length is encoded in one task; memory follows the longest document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

LENGTH = 1024
#: Texts of these characters, without two white spaces in a row or one at the end, are cut at white space.
PLAIN = re.compile("[\n\x20-\x7e\u00a1-\u024f]*").fullmatch
UNEVEN = re.compile("[ \n][ \n]|[ \n]$").search
MOST_WORDS = 1_000_000
#: Fixed value: the pre-token pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "The quick brøwn fox's 12 jumps,\nover Straße! it'll do.\nlowered unhappiness x"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Text to uint32 ids, equal to the tokenizer's own with add_special_tokens=False.

    The byte-level pre-tokenizer never joins what a single white space parts: a blank goes with the word after
    it and a line break is a pre-token of its own. So a text of single blanks and line breaks is the
    concatenation of its words' ids, where ``known`` maps 'word' to the ids of ' word' and '\\nword' to those of
    a line break and 'word'.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.whole("\n")
        self.known: dict[str, bytes] = {}
        self.most = most
        self.cut = len(self.line) == 4 and self.fast()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fast(self) -> bool:
        """Whether the same vocabulary, read as merge ranks by a second library that is faster on single words, agrees."""
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        try:
            ranks = {bytes(back[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return np.array(self.words(PROBE), "<u4").tobytes() == self.whole(PROBE)
        except (KeyError, ValueError):
            return False

    def learn(self, words: list[str]) -> None:
        """Add words, encoded as the lines of one text."""
        text = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in words])
        ids = np.array(self.words(text), "<u4")
        ends = np.flatnonzero(ids == int.from_bytes(self.line, "little")) * 4
        raw, starts = ids.tobytes(), [0, *(ends + 4).tolist()]
        for w, i, j in zip(words, starts, [*ends.tolist(), len(raw)]):
            self.known[w] = self.line + raw[i:j] if w[0] == "\n" else raw[i:j]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut or not PLAIN(text) or UNEVEN(text) or text[0] in " \n" or any(x in text for x in self.special):
            return self.whole(text)
        words, known = ("\n" + text.replace("\n", " \n")).split(" "), self.known
        try:
            return b"".join([known[w] for w in words])[4:]
        except KeyError:
            pass
        new = list({w for w in words if w not in known})
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(set(words))
        self.learn(new)
        return b"".join([known[w] for w in words])[4:]


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    whole, rest = divmod(n, length)
    return [length] * whole + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(path, length, keep_ids):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, crc, part = Encoder(path), zlib.crc32, TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                piece = batch.slice(i, 500)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n, start = len(ids) // 4, 0
                    for size in piece_lengths(n, length):
                        b = size.bit_length() - 1
                        k = numbers.get(b, 0)
                        numbers[b] = k + 1
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, size, crc(own), n, b << 59 | part << 33 | k, 0, b) + ((own,) if keep_ids else ()))
                        start += size
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * keep_ids
                kinds = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def pow2_packing(docs: DataFrame, path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row a piece; keep_ids adds the ids themselves (little-endian 32-bit) as a binary column.

    length: the longest piece, a power of two up to 2**15.
    """
    small_batches(docs.sparkSession)
    if length & (length - 1) or not 1 <= length <= 2**15:
        raise ValueError("length must be a power of two up to 32768")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_pack(path or vocabulary_path(), length, keep_ids), SCHEMA + ", ids binary" * keep_ids)


def op6_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pow2_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
