"""Byte-level BPE by ranks: each merge is found and applied through a segment tree of wide nodes."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Remembered, fresh, utf8

#: Bytes of pieces and ids that a task remembers; rows worked on at a time.
MEMORY, ROWS = 120 << 20, 400
#: Children of a node of the tree; the rank of a pair that is no token.
FAN, NONE = 32, 1 << 30


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of base64 tokens and decimal ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> array:
    """The ids of one piece.

    Leaf ``i`` of the tree holds the rank of the pair that starts at byte ``i``; a node
    holds the least of ``FAN`` below it.  The first least one of the top, and so down to
    the leaves, is the leftmost pair of least rank.  A merge clears one leaf and renews
    two; each path to the top ends where nothing changes.
    """
    n = len(piece)
    get = ranks.get
    after, before = [*range(1, n + 2)], [*range(-1, n)]
    leaves = top = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    tree = [leaves]
    while len(top) > FAN:
        top = [min(top[i : i + FAN]) for i in range(0, len(top), FAN)]
        tree.append(top)
    tall = len(tree) > 1
    while top and (rank := min(top)) != NONE:
        i = top.index(rank)
        for level in tree[-2::-1] if tall else ():
            i = level.index(rank, i * FAN)
        j = after[i]
        k = after[i] = after[j]
        if j < n - 1:
            leaves[j] = NONE
        if k < n:
            before[k] = i
            leaves[i] = NONE if after[k] - i > longest else get(piece[i : after[k]], NONE)
        else:
            leaves[i] = NONE
        h = before[i]
        if i:
            leaves[h] = NONE if k - h > longest else get(piece[h:k], NONE)
        if tall:
            for at in (i, min(j, n - 2), max(h, 0)):
                for below, level in zip(tree, tree[1:], strict=False):
                    at //= FAN
                    least = min(below[at * FAN : at * FAN + FAN])
                    if level[at] == least:
                        break
                    level[at] = least
    ids, i = array("i"), 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return ids


class Pieces(Remembered):
    """Pieces to the bytes of their 32-bit ids, remembered within ``MEMORY`` bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(MEMORY)
        self.ranks, self.longest = ranks, max(map(len, ranks))

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = array("i", [rank]) if rank is not None else merge(raw, self.ranks, self.longest)
        return self.remember(piece, ids.tobytes(), 5 * len(raw))


def coder(path: str, pattern: str, decoded: bool):
    """For mapInArrow: the batch's columns but ``text``, then ids and, if asked, what they decode to."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        split, pieces = regex.compile(pattern).findall, Pieces(ranks)
        token = {i: t for t, i in ranks.items()}.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                names = [c for c in batch.schema.names if c != "text"]
                coded = [b"".join(map(pieces.__getitem__, split(t.decode("utf-8", "replace")))) for t in batch["text"].to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), np.int32))
                columns = [batch[c] for c in names] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
                if decoded:
                    columns.append(pa.array([b"".join(map(token, np.frombuffer(x, np.int32).tolist())) for x in coded], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "decoded"][: len(columns)])

    return code


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with the token ids of each whole text, and what the ids decode to if ``decoded`` names a column.

    Null and empty texts have no ids.  Bytes that are not UTF-8 count as U+FFFD.
    Rows are independent, so ties, repeated rows and any other columns are as
    they were; an empty table stays empty.  Columns named like the new ones raise.
    """
    keep = docs.columns if keep is None else keep
    if clash := {ids, decoded} & set(keep):
        raise ValueError(f"columns exist: {sorted(clash)}")
    rest = fresh(docs, "rest")
    rows = docs.select(F.struct(F.lit(0), *keep).alias(rest), utf8(text).alias("text"))
    kind = f"{rest} {rows.schema[rest].dataType.simpleString()}, ids array<int>" + ", decoded binary" * bool(decoded)
    out = rows.mapInArrow(coder(path, pattern, bool(decoded)), kind)
    new = [F.col("ids").alias(ids)] + ([F.col("decoded").alias(decoded)] if decoded else [])
    return out.select(*(F.col(rest)[c].alias(c) for c in keep), *new)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each row's ids; null ids give null, an unknown id raises."""

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {i: t for t, i in ranks_of(path).items()}.__getitem__
        for rows in batches:
            yield rows.map(lambda x: None if x is None else b"".join(map(token, x.tolist())))

    return docs.withColumn(decoded, joined(ids))
