import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns and some whose names the operators use."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "x") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", uid int, score int, kept string")

    return make


@pytest.fixture
def saved(spark, tmp_path, frame):
    """The same as a file, for operators that read a table more than once."""

    def make(pairs, files=2):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        frame(pairs).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
