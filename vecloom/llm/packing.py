"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n: as many of the
longest sequence as fit, then the binary digits of the rest, longest first. Every piece is a sequence
of its own, so that none crosses documents and none is padded. Sequences of one length form a bucket,
from which a trainer draws its batches: the leading bits of a sequence's id are its bucket, the longest
first, so that buckets are ranges of ids; within each output partition they follow one another.

Tokens are the tokenizer's, but each distinct stretch between ASCII white space is tokenized once
in a worker: this tokenizer drops white space and never joins what it separates. Plain stretches
(ASCII and Latin-1 letters, digits, signs) are split as its pattern splits them and go straight to
its model; any other stretch goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import with_row_key

LENGTH = 2048
END_ID = 1
#: Where a sequence's id has its bucket; below it there is room for 2 ** 25 partitions.
BUCKET_BIT = 58
#: Stretches and words that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Longer ones are not remembered, so that what a worker holds is bounded in bytes too.
SHORT = 64
#: Characters of a text that are split at a time.
BLOCK = 1 << 20

#: Stretches that need no normalization but lower case; the pattern is the tokenizer's, for these.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: White space to Python's str.split() that is none to the tokenizer, or not surely.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if it prints, else one from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Stretches(dict):
    """Token ids of a stretch of text, as little-endian unsigned 32-bit bytes; found when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.words = tokenizer, tokenizer.model, {}
        letters = byte_letters()
        self.latin = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, stretch: str) -> bytes:
        if _PLAIN.fullmatch(stretch) and not _SPECIAL.search(stretch):
            found = b"".join([self.words.get(part) or self.word(part) for part in _PARTS.findall(stretch.lower())])
        else:
            found = np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(stretch) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = found
        return found

    def word(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.translate(self.latin))]
        found = np.array(ids, dtype="<u4").tobytes()
        if len(part) <= SHORT:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[part] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return b"".join(map(self.__getitem__, stretches(text)))
        out, at = [], 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):  # up to the next white space, so that no stretch is cut
                following = re.compile(r"[\x20\x09-\x0D]").search(text, end)
                end = following.start() if following else len(text)
            out.append(b"".join(map(self.__getitem__, stretches(text[at:end]))))
            at = end
        return b"".join(out)


def stretches(text: str) -> list[str]:
    return _ASCII_WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def pieces(n: int, longest: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    bit = longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


_WORKERS: dict[str, Stretches] = {}


def worker(path: str) -> Stretches:
    """This worker's tokenizer, kept from task to task."""
    if path not in _WORKERS:
        from tokenizers import Tokenizer

        _WORKERS[path] = Stretches(Tokenizer.from_file(path))
    return _WORKERS[path]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         longest: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    longest is a power of two. start counts the document's ids before the piece; ids_crc32 is over the
    ids as unsigned little-endian 32-bit numbers; doc_tokens counts the document's ids with end_id,
    which ends it. A null or empty text is end_id alone. A piece is its sequence's only one, so offset
    is 0. sequence_id is bucket * 2 ** BUCKET_BIT and a number, bucket being log2(longest / length). Rows are packed one by one, repeated and null ids too; ids may be of any type. An empty table gives an empty result;
    other columns are not read. with_ids=False leaves the ids out.
    """
    if not 0 < longest < 1 << 32 or longest & (longest - 1):
        raise ValueError("longest must be a power of two below 2 ** 32")
    end = np.array([end_id], dtype="<u4").tobytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker(tokenizer_path)
        for part in parts:
            docs = part.column(0).to_pylist()
            rows, texts, held = [], [], 0
            for doc, text in zip(docs, part.column(1)):
                ids = known.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in pieces(n, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(piece), n))
                    if with_ids:
                        texts.append(piece)
                held += len(ids)
                if held >= 1 << 24:
                    yield batch(rows, texts, part.column(0).type)
                    rows, texts, held = [], [], 0
            yield batch(rows, texts, part.column(0).type)

    def batch(rows: list, texts: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64() if i else kind) for i, c in enumerate(zip(*rows) if rows else [[]] * 5)]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in texts]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(texts), dtype="<i4"))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bucket = F.lit(longest.bit_length()) - F.length(F.bin("length"))
    number = F.shiftleft(bucket.cast("bigint"), BUCKET_BIT) + F.monotonically_increasing_id()
    out = rows.mapInArrow(batches, schema).withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("bigint"))
    return out.sortWithinPartitions(F.desc("length"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pack()'s sequences under path/length=<n>: a bucket holds the sequences of one length.

    Rows are not shuffled: within a partition they come in buckets, so a task has one file open at a time.
    Every sequence is written, of documents with null or repeated ids too; none are, no file is.
    """
    packed.write.partitionBy("length").parquet(path)
