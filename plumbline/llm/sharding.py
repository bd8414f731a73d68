"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row number -> place is pure arithmetic, so any row's shard and slot can be
computed, and inverted, without data.  Native DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

SHARDS = 24
ROUNDS = 6
#: Round constants: multipliers and offsets below the prime 2^31 - 1.
PRIME = 2147483647
KEYS = tuple(((1103515245 * (i + 1) + 12345) % PRIME, (69069 * (i + 7) * (i + 11) + 1) % PRIME) for i in range(ROUNDS))


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. rows - 1.

    The domain is ``a * b >= rows`` with ``a`` and ``b`` near the square root, so
    fewer than ``a`` places lie outside.  A row that lands there walks on along
    its cycle; ``steps`` is the longest such walk.
    """

    rows: int
    steps: int = 1

    @property
    def sides(self) -> tuple[int, int]:
        if self.rows < 2:
            return 1, max(1, self.rows)
        a = math.isqrt(self.rows - 1) + 1
        return a, -(-self.rows // a)

    def once(self, x: Column) -> Column:
        """One pass of the rounds over the domain; each round keeps one half and shifts the other."""
        a, b = self.sides
        rounds = F.array(
            *(F.struct(F.lit(m).cast("long"), F.lit(c).cast("long"), F.lit((a, b)[i % 2]).cast("long")) for i, (m, c) in enumerate(KEYS))
        )
        halves = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

        def step(h: Column, key: Column) -> Column:
            f = (h["r"] % PRIME * key["col1"] + key["col2"]) % PRIME
            return F.struct(h["r"].alias("l"), ((h["l"] + f * f % PRIME) % key["col3"]).alias("r"))

        return F.aggregate(rounds, halves, step, lambda h: h["l"] * b + h["r"])

    def place(self, x: Column) -> Column:
        """Where row number ``x`` goes."""
        walk = F.sequence(F.lit(1), F.lit(self.steps))
        return F.aggregate(walk, self.once(x), lambda at, _: F.when(at < self.rows, at).otherwise(self.once(at)))


def feistel(spark: SparkSession, rows: int) -> Feistel:
    """The permutation for so many rows, with the longest walk measured on the places outside."""
    a, b = Feistel(rows).sides
    if a * b == rows or rows == 0:
        return Feistel(rows)
    outside, steps = spark.range(rows, a * b).select(F.col("id").alias("x")), 1
    while True:
        # From outside this is steps + 1 passes, which a row has after its first with steps + 1.
        longer = outside.where(Feistel(rows, steps).place(F.col("x")) >= rows)
        if longer.isEmpty():
            return Feistel(rows, steps + 1)
        steps *= 2


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0, 1, ... in ``order``, and their count; no single-task window.

    The range partitions are written once, so their counts, which alone reach the
    driver, hold for whatever is read later.
    """
    sorted_ = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    kept = materialize(sorted_, "numbered")
    counts = sorted(kept.groupBy("range").count().collect())
    before, starts = 0, []
    for r, n in counts:
        starts.append((r, before))
        before += n
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "range int, before long"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = kept.withColumn("within", within).join(offsets, "range")
    return out.withColumn("row_number", F.col("before") + F.col("within") - 1).drop("range", "within", "before"), before


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Every row with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: shard sizes differ by one row at most, and slots of a
    shard run from 0 without a gap.  Rows are numbered by doc_id (null first),
    then text hash, so equal tables give equal shards whatever their order.  A
    null text counts as empty; repeated rows are numbered apart; an empty table
    gives an empty result.  Columns other than the two named are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
    )
    with_number, n = numbered(rows, ["doc_id", "_text_hash"])
    place = feistel(docs.sparkSession, n).place(F.col("row_number"))
    return with_number.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
