"""Exact duplicates by compressed radix tries over whole byte strings.

Each task first folds its own copies in a trie, so a text that a third of the
corpus repeats leaves a task once.  The distinct strings then go to partitions
by length and content hash; the trie that owns a partition inserts them whole,
and its terminal nodes keep the smallest identifier.  Equal means equal bytes:
the hash only routes.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, fresh, utf8
from plumbline.session import materialize

#: Bytes of strings a trie holds before it starts over (folding) or spills subtrees (owning).
FOLD_BYTES = 64 << 20
OWN_BYTES = 128 << 20

_FOLDED = "uid long, doc_id long, chars long, cls long, n_bytes long, hash long, sha256 string, body binary"


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` shares with ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("edge", "children", "owner", "spill")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.children, self.owner, self.spill = edge, {}, None, None


class PatriciaTrie:
    """Byte strings to owners; a terminal node keeps the smallest identifier offered.

    Beyond ``budget`` bytes of edges the heaviest subtree below the root goes to a
    file, and later strings that reach it follow; ``groups`` reads such files back
    into tries of their own.  The files are the task's and end with it.
    """

    def __init__(self, budget: int = OWN_BYTES, depth: int = 0) -> None:
        self.root, self.budget, self.held, self.depth = Node(b""), budget, 0, depth

    def insert(self, key: bytes, identifier) -> Node | None:
        """The terminal node of ``key``; None if its subtree is on disk."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += end - at + 200
                node, at = child, end
                break
            if child.spill is not None:
                pickle.dump((key, identifier), child.spill)
                return None
            same = shared_length(child.edge, key, at)
            if same < len(child.edge):
                upper = Node(child.edge[:same])
                node.children[key[at]] = upper
                child.edge = child.edge[same:]
                upper.children[child.edge[0]] = child
                child = upper
                self.held += 200
            node, at = child, at + same
        if node.owner is None or identifier < node.owner:
            node.owner = identifier
        return node

    def members(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node
            stack += [(c, prefix + c.edge) for c in node.children.values() if c.spill is None]

    def spill_heaviest(self, listed: dict[int, list]) -> None:
        """Write the heaviest subtree to disk: its strings with every identifier they were given.

        The cut is below the last node that all held strings pass, so it moves
        down as the common prefix grows.
        """
        top, prefix = self.root, b""
        while top.owner is None and len(top.children) == 1 and next(iter(top.children.values())).spill is None:
            top = next(iter(top.children.values()))
            prefix += top.edge
        live = [(b, c) for b, c in top.children.items() if c.spill is None]
        if not live:
            return
        weigh = lambda c: sum(len(n.edge) + 200 for _, n in self.members(c, b""))
        first, heavy = max(live, key=lambda x: weigh(x[1]))
        freed = weigh(heavy)
        out = Node(heavy.edge[:1])
        out.spill = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
        for key, node in self.members(heavy, prefix + heavy.edge):
            for identifier in listed.pop(id(node)):
                pickle.dump((key, identifier), out.spill)
        top.children[first] = out
        self.held = max(0, self.held - freed)

    def groups(self, rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, int]]:
        """Each identifier of ``rows`` with the smallest one of the same string."""
        listed: dict[int, list] = {}
        kept: dict[int, Node] = {}
        for key, identifier in rows:
            node = self.insert(key, identifier)
            if node is not None:
                listed.setdefault(id(node), []).append(identifier)
                kept[id(node)] = node
            if self.held > self.budget and self.depth < 64:
                self.spill_heaviest(listed)
                kept = {k: v for k, v in kept.items() if k in listed}
        for k, identifiers in listed.items():
            owner = kept[k].owner
            for identifier in identifiers:
                yield identifier, owner
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.spill is not None:
                node.spill.seek(0)
                yield from PatriciaTrie(self.budget, self.depth + 1).groups(_pickled(node.spill))
                node.spill.close()
            stack.extend(node.children.values())


def _pickled(file) -> Iterator:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _fold(budget: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row with the class its task gave its string; the string itself once per class."""
        base = TaskContext.get().partitionId() << 33
        trie, n = PatriciaTrie(budget), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch["text"].to_pylist():
                body = text.translate(None, BLANKS)
                node = trie.insert(body, base + n)
                new = node.owner == base + n
                for column, value in zip(
                    out,
                    (base + n, node.owner, len(body), xxhash.xxh64_intdigest(body) >> 1,
                     hashlib.sha256(body).hexdigest(), body if new else None),
                    strict=True,
                ):
                    column.append(value)
                n += 1
                if trie.held > budget:
                    trie = PatriciaTrie(budget)
            uid, cls, size, hashed, sha, body = out
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), batch["doc_id"], batch["chars"], pa.array(cls, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(hashed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(body, pa.binary())],
                ["uid", "doc_id", "chars", "cls", "n_bytes", "hash", "sha256", "body"],
            )

    return fold


def _own(budget: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every class with the smallest class of the same string."""
        rows = ((body, cls) for b in batches for body, cls in zip(b["body"].to_pylist(), b["cls"].to_pylist(), strict=True))
        found: list[tuple[int, int]] = []
        for pair in PatriciaTrie(budget).groups(rows):
            found.append(pair)
            if len(found) == 50_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return own


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["cls", "root"]
    )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    fold_bytes: int = FOLD_BYTES, own_bytes: int = OWN_BYTES,
) -> DataFrame:
    """One row per input row: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after deleting blanks; null counts as
    empty, and all empty texts are one group.  Of a group the row with the most
    code points in its original text stays, then the smallest doc_id (null last),
    then the first row; of repeated rows exactly one is kept.  Columns other than
    the two named are not read.  An empty table gives an empty result.  ``uid`` is
    the row's ``monotonically_increasing_id``.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"),
        utf8(text).alias("text"),
    )
    folded = materialize(rows.mapInArrow(_fold(fold_bytes), _FOLDED), "folded")
    strings = folded.where("body is not null").select("cls", "n_bytes", "hash", "body")
    roots = materialize(
        strings.repartition("n_bytes", "hash").select("cls", "body").mapInArrow(_own(own_bytes), "cls long, root long"),
        "owners",
    )
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("best")
    local = folded.groupBy("cls").agg(best, F.count("*").alias("n")).join(roots, "cls")
    whole = local.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    classes = local.select("cls", "root").join(whole, "root").select("cls", "best", "n")
    return folded.select("uid", "doc_id", "cls", "sha256").join(classes, "cls").select(
        "uid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = fresh(docs, "row_uid")
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("uid").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
