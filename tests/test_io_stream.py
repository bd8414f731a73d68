"""Sources, sinks, previews, session helpers and row-wise steps on a stream."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.clean_runs import clean_table
from plumbline.plans.fixtures import table
from plumbline.session import bounded, materialize, shared_dir
from plumbline.sources import io
from plumbline.streaming.rowwise import clean_rows


def test_csv_round_trip_trims_names_and_infers_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(" a ,b\n1,x\n,\n3,NaN\n")
    df = io.load(spark, str(path))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "int"
    assert df.where("a is null").count() == 1
    typed = io.load(spark, str(path), schema="a double, b string")
    assert dict(typed.dtypes)["a"] == "double"


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_saved_tables_load_again(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a bigint, b string")
    path = io.save_table(df, str(tmp_path), "t", fmt)
    assert sorted(map(tuple, io.load(spark, path).select("a").collect())) == [(1,), (2,)]


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError):
        io.load(spark, "x.docx")


def test_report_is_written_as_json(spark, sf_dir, tmp_path):
    run = clean_table(table(spark, sf_dir, "dirty_events"))
    path = io.save_report(run.report(spark), str(tmp_path))
    assert spark.read.json(path).where("metric = 'rows_after'").count() == 1


def test_preview_renders_missing_as_empty_text(spark):
    df = spark.createDataFrame([(3, None), (1, float("nan")), (2, 1.5)], "k int, v double")
    assert [tuple(r) for r in io.preview(df, ["k"], 2).collect()] == [("1", ""), ("2", "1.5")]


def test_bounded_proves_its_bound(spark):
    assert bounded(spark.range(5), 5)[1]
    assert not bounded(spark.range(6), 5)[1]


def test_materialize_writes_under_the_shared_folder(spark):
    df = materialize(spark.range(3).withColumn("x", F.lit("a")))
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark).replace("file:", ""))
    assert df.count() == 3


def test_rowwise_steps_run_on_a_stream(spark, sf_dir, tmp_path):
    batch = table(spark, sf_dir, "dirty_events")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        clean_rows(stream, fills={"value": 1.0})
        .writeStream.format("memory")
        .queryName("cleaned_stream")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.table("cleaned_stream")
    expected = clean_rows(batch, fills={"value": 1.0})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    assert got.where("value is null or event_type = ''").count() == 0


def test_csv_as_people_write_it(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e,f\n"He said ""hi"", ok",10,NA,1.5,true,2024-01-05\nx,NA,n/a,-2,FALSE,2024-01-06 10:00:00\n"",5,7,none,,\n')
    df = io.load(spark, str(path))
    assert dict(df.dtypes) == {"a": "string", "b": "int", "c": "int", "d": "double", "e": "boolean", "f": "timestamp_ntz"}
    assert [tuple(r)[:5] for r in df.collect()] == [
        ('He said "hi", ok', 10, None, 1.5, True), ("x", None, None, -2.0, False), (None, 5, 7, None, None),
    ]


def test_bounded_counts_bytes_too(spark):
    assert not bounded(spark.createDataFrame([("x" * 100,)], "s string"), 5, 99)[1]
    assert bounded(spark.createDataFrame([("x" * 100,)], "s string"), 5, 100)[1]


def test_written_tables_go_when_released(spark):
    import os

    from plumbline.session import release

    df = materialize(spark.range(3))
    path = df.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
    assert os.path.exists(path)
    release(df)
    assert not os.path.exists(path)
