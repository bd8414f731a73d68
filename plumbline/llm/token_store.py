"""Token ids in files of bit-packed blocks.

A file is Parquet so that Spark commits, lists and recovers it; a row is a block
of whole documents in ascending doc_id order:

    part, block         the range of doc_ids, and the block's number within it
    first               ids in the part before the block
    width               bits of an id: the least that hold the largest id of the vocabulary
    doc_ids, offsets    the documents, and where each begins in the block (one more: the end)
    packed              all ids, ``width`` bits each, low bits first, padded to a whole byte

Document ``i`` is the ids offsets[i] to offsets[i + 1], whose bits start at
width * offsets[i]: it can be unpacked alone.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Remembered, utf8

#: Ids of a block (a longer document has a block of its own); bytes of words and ids that a task remembers.
BLOCK_IDS, MEMORY = 1 << 18, 120 << 20

BLOCK = "part int, block int, first long, width int, doc_ids array<long>, offsets array<long>, packed binary"


def width_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as consecutive ``width``-bit numbers, low bits first."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    parts = []
    for at in range(0, len(ids), 1 << 17):
        bits = (ids[at : at + (1 << 17), None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(packed: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop``, reading only the bytes that hold them."""
    n = stop - start
    if n <= 0:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(packed, np.uint8)
    padded = np.concatenate([raw[first // 8 : (stop * width + 7) // 8], np.zeros(8, np.uint8)])
    at = np.arange(n, dtype=np.int64) * width + first % 8
    byte = at >> 3
    value = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        value |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    value >>= (at & 7).astype(np.uint64)
    return (value & np.uint64((1 << width) - 1)).astype(np.uint32)


class WordIds(Remembered):
    """Ids of words between ASCII blanks as the bytes of 32-bit numbers, remembered within ``MEMORY`` bytes.

    The tokenizer lower-cases, drops white space and never merges across it.  Words
    of plain letters go straight to its merge model, signs after them and all else
    through its whole encoder.  With ``special``, added tokens are found in the raw text
    first, as the library does by default; without, they are text like any other.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        super().__init__(MEMORY)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.added = {t.content.encode(): array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items() if special}
        self.cut = re.compile(b"(" + b"|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + b")").split if self.added else None
        # The byte alphabet of byte-level models: printable bytes as they are, the others from U+0100 on.
        printable, others = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
        self.alphabet = {b: chr(b if b in printable else next(others)) for b in range(256)}

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(string.punctuation)  # after a letter such a run is a piece of its own
        lower = core.lower()
        # Up to U+017F letters are composed already, and lower-casing needs no neighbours.
        plain = lower.isalpha() and core.isalpha() and (core.isascii() or max(core) < "\u0180")
        if plain and len(core) < len(word):
            found = self[core.encode()] + self[word[len(core) :].encode()]
        elif plain:
            spelled = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.alphabet)
            found = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return self.remember(raw, found, len(raw) + len(found))


def encoded(words: WordIds, raw: bytes) -> bytes:
    """The ids of a whole text as the bytes of 32-bit numbers."""
    if words.cut is None or not any(map(raw.__contains__, words.added)):
        return b"".join(map(words.__getitem__, raw.lower().split()))
    parts = words.cut(raw)
    return b"".join(words.added[p] if k % 2 else b"".join(map(words.__getitem__, p.lower().split())) for k, p in enumerate(parts))


def _blocks(path: str, end_id: int | None, width: int, block_ids: int, special: bool):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, n = WordIds(path, special), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        coded: list[bytes] = []
        held = first = 0

        def block() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(x) // 4 for x in coded)])
            packed = pack(np.frombuffer(b"".join(coded), "<u4"), width)
            row = {"part": part, "block": n, "first": first, "width": width, "doc_ids": doc_ids, "offsets": offsets.tolist(), "packed": packed}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
             ("offsets", pa.list_(pa.int64())), ("packed", pa.binary())]
        )
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoded(words, raw) + end
                if coded and held + len(ids) > 4 * block_ids:
                    yield block()
                    n, first, doc_ids, coded, held = n + 1, first + held // 4, [], [], 0
                doc_ids.append(doc_id)
                coded.append(ids)
                held += len(ids)
        if coded:
            yield block()

    return blocks


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int | None = None,
    doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, special: bool = False,
) -> None:
    """Encode every whole text and write the blocks under ``path``, parts in ascending doc_id order.

    Null counts as empty; an empty text has only the end id, if there is one.
    Null doc_ids come first, rows of equal id in any order, each once; an empty
    table writes no block.  With ``special``, the tokenizer's added tokens in a text
    have their own ids, else they are split as text.  Columns other than the two named are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    packed = rows.mapInArrow(_blocks(tokenizer, end_id, width_for(vocabulary - 1), block_ids, special), BLOCK)
    packed.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            offsets = np.array(row["offsets"], np.int64)
            ids = unpack(row["packed"], row["width"], 0, int(offsets[-1]))
            values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            starts = pa.array(row["before"] + offsets[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), starts, values], ["doc_id", "start", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _documents(batches):
        ids = batch["ids"]
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], sizes, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``before``: the ids of all earlier blocks.

    Totals per part, one number for each partition written, go through the driver.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.groupBy("part").agg(F.max(F.col("first") + F.element_at("offsets", -1)))
    starts, before = [], 0
    for part, n in sorted(totals.collect()):
        starts.append((part, before))
        before += n
    of_part = F.broadcast(spark.createDataFrame(starts, "part int, of_part long"))
    return blocks.join(of_part, "part").withColumn("before", F.col("of_part") + F.col("first"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document under ``path``."""
    return _placed(spark, path).mapInArrow(_documents, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the little-endian 32-bit ids of every document under ``path``."""
    return _placed(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
