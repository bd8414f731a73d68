"""CSV records whose quoted cells may hold line breaks, read from all splits of a file at once.

Whether a line begins a record depends on every quote before it.  So a first pass
follows the quotes of each split twice, as if its first line lay outside and as if
it lay inside a quoted cell, and keeps only where the two ways end.  Put together
in file order (a prefix scan over one small row per split that has quotes), these
tell how every split really begins.  A second pass cuts records by that; only a
record that crosses the end of a split has its pieces brought together by a shuffle.

Lines end with a line feed; a carriage return before it goes unless the line ends
inside a cell.  A quote opens a cell only as its first character, and inside a cell
a quote is written twice.
"""

from __future__ import annotations

import csv
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "record string, cells int, first boolean, file long, start long, chain long"
_RECORDS = pa.schema(
    [("record", pa.string()), ("cells", pa.int32()), ("first", pa.bool_()), ("file", pa.int64()), ("start", pa.int64()), ("chain", pa.int64())]
)
_ENDS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("closes", pa.bool_())])

#: Of a file, in order: (start of a split, whether what follows it begins inside a cell, the split where that record began).
Turns = dict[int, list[tuple[int, bool, int]]]


class Quotes:
    """Follows the quotes of lines."""

    def __init__(self, sep: str, quote: str) -> None:
        self.sep, self.quote = sep, quote
        q = re.escape(quote)
        self.opening = re.compile(rf"(?:\A|{re.escape(sep)}){q}")
        self.body = re.compile(rf"[^{q}]*(?:{q}{q}[^{q}]*)*")

    def after(self, line: str, inside: bool) -> bool:
        """Whether the line after ``line`` begins inside a cell."""
        at = 0
        while True:
            if inside:
                at = self.body.match(line, at).end()
                if at >= len(line):
                    return True
                at += 1
            found = self.opening.search(line, at)
            if found is None:
                return False
            at, inside = found.end(), True

    def cells(self, record: str) -> int:
        if self.quote not in record:
            return record.count(self.sep) + 1
        try:
            return len(next(csv.reader([record.replace("\n", " ").replace("\r", " ")], delimiter=self.sep, quotechar=self.quote), []))
        except csv.Error:  # a cell beyond the module's limit
            return _cells_by_hand(self, record)


def _cells_by_hand(quotes: Quotes, record: str) -> int:
    n, at = 1, 0
    while at < len(record):
        if record.startswith(quotes.quote, at):
            at = quotes.body.match(record, at + 1).end() + 1
        at = record.find(quotes.sep, at)
        if at < 0:
            return n
        n, at = n + 1, at + len(quotes.sep)
    return n


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start, lines) of runs of lines of one split, in order."""
    for batch in batches:
        file, start = (batch[c].to_numpy(zero_copy_only=False) for c in ("file", "start"))
        cuts = [0, *(((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1), len(file)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(file[a]), int(start[a]), batch["value"].slice(a, b - a)


def _ends(quotes: Quotes):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every split, from its lines with quotes: where both ways end, and whether the way from inside comes out."""
        out: list[dict] = []
        for file, start, lines in _splits(batches):
            if not out or (out[-1]["file"], out[-1]["start"]) != (file, start):
                out.append({"file": file, "start": start, "outside": False, "inside": True, "closes": False})
            one = out[-1]
            for line in lines.to_pylist():
                same = one["outside"] == one["inside"]
                one["outside"] = quotes.after(line, one["outside"])
                one["inside"] = one["outside"] if same else quotes.after(line, one["inside"])
                one["closes"] |= not one["inside"]
        yield pa.RecordBatch.from_pylist(out, _ENDS)

    return ends


def scan(ends: list[tuple[int, int, bool, bool, bool]]) -> Turns:
    """How splits begin, from how the splits before them end; only changes are kept."""
    turns: Turns = {}
    state: dict[int, tuple[bool, int]] = {}
    for file, start, outside, inside, closes in sorted(ends):
        before = state.get(file, (False, 0))
        after = inside if before[0] else outside
        # A record that is open at the end began here, unless the split never left the cell it began in.
        state[file] = (after, (start if not before[0] or closes else before[1]) if after else 0)
        if state[file] != before:
            turns.setdefault(file, []).append((start, *state[file]))
    return turns


def _records(quotes: Quotes, turns: Turns):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None  # the split at hand
        held: list[str] | None = None  # lines of the record that is open
        chain: int | None = None  # where that record began, if in an earlier split
        head = False  # the open record is the first of its file
        out: list[tuple] = []

        def emit(record: str, first: bool, piece_of: int | None) -> None:
            out.append((record, quotes.cells(record), first, state[0], state[1], piece_of))

        def leave() -> None:
            """At the end of a split an open record is a piece of one."""
            if held is not None:
                emit("\n".join(held), head, state[1] if chain is None else chain)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)
            out.clear()
            return batch

        for file, start, lines in _splits(batches):
            new = state != (file, start)
            if new:
                if state is not None:
                    leave()
                state = (file, start)
                before = turns.get(file, [])
                at = bisect_left(before, (start,)) - 1
                inside = at >= 0 and before[at][1]
                held, chain, head = ([], before[at][2], False) if inside else (None, None, False)
            first = new and start == 0
            if out:
                yield ready()
            quoted = pc.match_substring(lines, quotes.quote)
            if held is None and not pc.any(quoted).as_py():
                cells = pc.add(pc.count_substring(lines, quotes.sep), 1).cast(pa.int32())
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [lines, cells, pa.array([first] + [False] * (n - 1)), pa.array([file] * n, pa.int64()), pa.array([start] * n, pa.int64()),
                     pa.nulls(n, pa.int64())], schema=_RECORDS,
                )
                continue
            for k, (line, has) in enumerate(zip(lines.to_pylist(), quoted.to_pylist(), strict=True)):
                inside = quotes.after(line, held is not None) if has else held is not None
                if held is None:
                    if inside:
                        held, chain, head = [line], None, first and k == 0
                    else:
                        emit(line, first and k == 0, None)
                    continue
                held.append(line)
                if not inside:
                    emit("\n".join(held), head, chain)
                    held, chain, head = None, None, False
                if len(out) >= 10_000:
                    yield ready()
        if state is not None:
            leave()
        yield ready()

    return records


def _counted(quotes: Quotes):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([quotes.cells(r) for r in batch["record"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["record"], cells, batch["first"]], ["record", "cells", "first"])

    return counted


def records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """record, cells, first: every record of the files under ``path`` that is not blank.

    ``first`` marks the first record of a file.  What reaches the driver is a row of two
    numbers and three flags for each split that has quotes, and what returns to the
    tasks is one for each split that begins inside a cell or ends such a stretch.  A
    file that ends inside a cell is an error, as no reading of it keeps its rows.
    """
    quotes = Quotes(sep, quote)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    schema = "file long, start long, outside boolean, inside boolean, closes boolean"
    ends = [tuple(r) for r in lines.where(F.contains("value", F.lit(quote))).mapInArrow(_ends(quotes), schema).collect()]
    turns = scan(ends)
    for changes in turns.values():
        if changes[-1][1]:
            raise ValueError(f"a file under {path!r} ends inside a quoted cell that began after byte {changes[-1][2]}")
    cut = lines.mapInArrow(_records(quotes, turns), RECORDS)
    whole = cut.where("chain IS NULL").select("record", "cells", "first") if turns else cut.select("record", "cells", "first")
    if turns:
        pieces = cut.where("chain IS NOT NULL").groupBy("file", "chain").agg(
            F.array_sort(F.collect_list(F.struct("start", "record"))).alias("pieces"), F.bool_or("first").alias("first")
        )
        joined = pieces.select(F.array_join(F.col("pieces.record"), "\n").alias("record"), "first")
        whole = whole.union(joined.mapInArrow(_counted(quotes), "record string, cells int, first boolean"))
    trimmed = F.regexp_replace("record", r"\r\z", "")
    trimmed = F.when(F.col("first"), F.regexp_replace(trimmed, "^\ufeff", "")).otherwise(trimmed)
    return whole.withColumn("record", trimmed).where(F.length(F.trim("record")) > 0)
