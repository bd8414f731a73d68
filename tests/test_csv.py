"""CSV with line breaks in cells over many splits, exact types, and rows of other lengths."""

import csv
import io as memory
import random
import re
import warnings
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st

from plumbline.config import DATE_FORMATS, DATE_START
from plumbline.sources import io, quoted
from plumbline.sources.lattice import _facts, _measures, types_by_content

PIECES = ["a", 'say "hi"', "two\nlines", "x,y", "\r\nz", "\n\n", '"', '""', "", "é", "\t"]


@pytest.fixture
def small_splits(spark):
    """Splits of so many bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield set_to
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(folder, name, rows):
    text = memory.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text.getvalue(), newline="")


@pytest.mark.parametrize("split", [90, 700, 20_000, 1 << 27])
def test_cells_with_line_breaks_are_whole_whatever_the_splits(spark, tmp_path, small_splits, split):
    rng = random.Random(split)
    n = 25 if split < 100 else 200
    tables = []
    for k in range(2):
        rows = [[f"{k}-{i}", " ".join(rng.choices(PIECES, k=rng.randint(0, 6))), "end"] for i in range(n)]
        written(tmp_path / "t.csv", f"part{k}.csv", [["id", "note", "last\ncolumn"], *rows])
        tables += rows
    small_splits(split)
    df = io.load(spark, str(tmp_path / "t.csv"), missing=(), ragged="column")
    assert df.columns == ["id", "note", "last\ncolumn", "_record"]
    got = sorted((r[0], r[1] or "", r[2], r[3]) for r in df.collect())
    strip = " \t\n\r\f\x0b"
    assert got == sorted((a, b.strip(strip), c, None) for a, b, c in tables)
    assert split > 1000 or spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 10


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    note = "\n".join(f'line {k}, "quoted"' for k in range(300))
    written(tmp_path / "t.csv", "a.csv", [["id", "note"], ["1", note], ["2", "b"], ["3", note + "\n"]])
    small_splits(600)
    got = {r.id: r.note for r in io.load(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {1: note, 2: "b", 3: note}


@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=4), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_two_ways_through_a_split_agree_with_reading_from_the_start(rows):
    text = memory.StringIO()
    csv.writer(text, lineterminator="\n").writerows([[",".join(r), *r] for r in rows])
    lines, quotes = text.getvalue().split("\n")[:-1], quoted.Quotes(",", '"')
    starts, inside = [], False
    for line in lines:
        starts.append(inside)
        inside = quotes.after(line, inside)
    assert not inside and starts.count(False) == len(rows)
    for size in (1, 2, 3):
        ends, state = [], {}
        for at in range(0, len(lines), size):
            ways = [False, True]
            closes = False
            for line in lines[at : at + size]:
                ways = [quotes.after(line, w) for w in ways]
                closes |= not ways[1]
            ends.append((7, at, *ways, closes))
        for at, after, _ in quoted.scan(ends).get(7, []):
            state[at] = after
        now = False
        for at in range(0, len(lines), size):
            assert starts[at] == now
            now = state.get(at, now)


def test_cells_are_counted_as_read():
    quotes = quoted.Quotes(",", '"')
    for record, n in (("", 1), ("a,b", 2), ('"a,b"', 1), ('"a\n,""b",c,', 3), ('"' + "x," * 100_000 + '",y', 2), ("a,\"b\"c,d", 3)):
        assert quotes.cells(record) == n == quoted._cells_by_hand(quotes, record)


def test_a_quote_that_never_closes_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        io.load(spark, str(tmp_path / "t.csv"))


def test_quotes_inside_plain_cells_are_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,x\n6,7" pipe\n')
    assert sorted(map(tuple, io.load(spark, str(tmp_path / "t.csv")).collect())) == [('5" pipe', "x"), ("6", '7" pipe')]


def test_blank_lines_marks_and_carriage_returns(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿"a",b\r\n\r\n1,"x\r\ny"\r\n   \r\n2,z\r\n'.encode())
    df = io.load(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [(1, "x\r\ny"), (2, "z")]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert io.load(spark, str(tmp_path / "e.csv")).collect() == []


def test_rows_of_other_lengths_are_reported(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3\n4,5,6\n7,"8,9"\n')
    with pytest.raises(Exception, match="more than the 2 cells"):
        io.load(spark, path)
    kept = io.load(spark, path, ragged="column")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "2", None), (3, None, "3"), (4, "5", "4,5,6"), (7, "8,9", None)]
    with pytest.raises(Exception, match="more than the 2 cells"):
        io.load(spark, path, schema="a int, b string").collect()
    (tmp_path / "s.csv").write_text("a,b\n1,2\n3\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        df = io.load(spark, str(tmp_path / "s.csv"))
    assert any("1 rows" in str(w.message) for w in seen) and sorted(map(tuple, df.collect())) == [(1, 2), (3, None)]


def test_other_separators_and_sparks_own_reader(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x\ny"\n')
    assert list(map(tuple, io.load(spark, str(tmp_path / "t.tsv")).collect())) == [(1, "x\ny")]
    (tmp_path / "s.csv").write_text("a;b\n1;'x\ny'\n")
    assert list(map(tuple, io.load(spark, str(tmp_path / "s.csv"), sep=";", quote="'").collect())) == [(1, "x\ny")]
    (tmp_path / "c.csv").write_text("a,b\n#x\n1,2\n")
    assert list(map(tuple, io.load(spark, str(tmp_path / "c.csv"), comment="#").collect())) == [(1, 2)]


# values -> the narrowest type that keeps them
CASES = {
    ("1", "-2", "+3"): "int",
    ("2147483647", "-2147483648"): "int",
    ("2147483648",): "bigint",
    ("1234567890123456789", "1234567890123456788"): "bigint",
    ("9223372036854775807", "-9223372036854775808"): "bigint",
    ("9223372036854775808", "1"): "decimal(38,0)",
    ("9" * 38,): "decimal(38,0)",
    ("9" * 39,): None,
    ("1.5", "2"): "double",
    ("0.1", "1e5", ".5"): "double",
    ("0.30000000000000004",): "double",
    ("12345678901234567.5",): "decimal(18,1)",
    ("1234567890123456789.25", "1"): "decimal(21,2)",
    ("1234567890123456789.25", "1e3"): None,
    ("1234567890123456789", "0.5"): "decimal(20,1)",
    ("007", "7"): None,
    ("0", "10", "0.5"): "double",
    ("true", "FALSE"): "boolean",
    ("2024-01-05", "2024-01-06 10:00:00"): "timestamp_ntz",
    ("1", "x"): None,
    ("1", "true"): None,
    (None, None): None,
    (None, "4"): "int",
}


def test_types_keep_every_value(spark):
    names = [f"c{i}" for i in range(len(CASES))]
    rows = [tuple((k[r] if r < len(k) else None) for k in CASES) for r in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    types, _ = types_by_content(df)
    assert {k: types.get(c) for k, c in zip(CASES, names, strict=True)} == CASES
    assert types_by_content(df.where("false"))[0] == {}
    assert types_by_content(spark.createDataFrame([("007",), ("7",)], "a string"), keep_zeros=False)[0] == {"a": "int"}


def test_each_value_is_read_as_a_number_once(spark):
    df = spark.createDataFrame([("12",), (" +0.50 ",), (None,)], "a string")
    facts = _facts(df, ["a"])
    assert [tuple(r)[1:] for r in facts.collect()] == [("12", 12.0, True, 2, 2, 0, Decimal(12)), ("+0.50", 0.5, False, 2, 0, 2, None), (None,) * 7]
    plan = facts.agg(*[m.alias(k) for k, m in _measures(0).items()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as double") == 1


def test_times_begin_as_their_shapes_do():
    for text in ("2024-01-05", "2024/1/5", "2024-01-05 10:00:00", "2024-01-05T10:00:00", "2024-01-05 10:00", "2024-01-05T10:00:00.5+01:00", "1/5/2024",
                 "12/31/2024", "5-1-2024", "31-12-2024", "5 Jan 2024", "31 Dec 2024", "Jan 5, 2024"):
        assert any(re.match(shape, text) for shape, _ in DATE_FORMATS) and re.match(DATE_START, text)
    assert all(any(re.match(shape, t) for t in ("2024-01-05", "2024/1/5", "2024-01-05 10:00:00", "2024-01-05T10:00:00", "2024-01-05 10:00", "1/5/2024", "5-1-2024", "5 Jan 2024", "Jan 5, 2024")) for shape, _ in DATE_FORMATS)


def test_parts_join_to_the_same_type_in_any_partitioning(spark):
    values = ["1", "2147483648", "12345678901234567890", "0.5", None]
    for n in (1, 5):
        df = spark.createDataFrame([(v,) for v in values], "a string").repartition(n)
        assert types_by_content(df)[0] == {"a": "decimal(21,1)"}


def test_long_numbers_stay_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount,code\n1234567890123456789,12345678901234567890.25,007\n1234567890123456788,0.5,7\n")
    df = io.load(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "amount": "decimal(22,2)", "code": "string"}
    assert sorted(map(tuple, df.collect())) == [
        (1234567890123456788, Decimal("0.50"), "7"), (1234567890123456789, Decimal("12345678901234567890.25"), "007"),
    ]
