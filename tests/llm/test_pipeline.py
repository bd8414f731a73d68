"""The registered corpus queries, and the pipeline stage by stage against plain code."""

import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare
from plumbline.llm import byte_bpe
from plumbline.llm.queries import CATALOG

RANKS = public_tokenizers.path(corpus_pipeline.RANKS)


def test_all_numbered_queries_and_the_pipeline_are_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert set(CATALOG) == set(names) and "pipeline" in queries()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("key", [k for k, q in CATALOG.items() if q.oracle])
def test_queries_match_sql(spark, con, sf_dir, key):
    assert compare(spark, con, sf_dir, key, oracle_sql()[key])[1].startswith("ok")


@pytest.mark.parametrize("key", [k for k, q in CATALOG.items() if not q.oracle])
def test_queries_return_every_row(spark, sf_dir, key):
    tables = {"op3": ("pages", "page_id"), "op11": ("embeddings", "vec_id"), "op12": ("conversations", "conv_id")}
    table, key_of = tables.get(key.split("_")[0], ("documents", "doc_id"))
    want = {r[0] for r in duckdb.sql(f"SELECT {key_of} FROM '{sf_dir}/{table}.parquet'").fetchall()}
    want |= {-1} if key.startswith("op12") else set()
    each = 8 if key.startswith("op11") else 1  # components of a vector
    rows = queries()[key](spark, sf_dir).collect()
    assert len(rows) == each * len(want) and {r[key_of] for r in rows} == want


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with each kind of thing that a stage must catch."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfglmnprt") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    rows, labels, expect = [], [], {}
    bad = ["skunko", "vilegrub", "rottenak"]
    add = lambda words, kind: (expect.__setitem__(len(rows), kind), rows.append((len(rows), words if words is None else " ".join(words))))
    for k in range(400):
        words = text(rng.randint(30, 120))
        if k % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        labels.append((len(rows), 1, int(k % 5 == 0)))
        add(words, "toxic" if k % 5 == 0 else "clean")
    items = [(k, " ".join(text(30))) for k in range(10)]
    for k in range(20):
        add(text(40) + items[k % 10][1].split() + text(40), "leak")
    for k in range(20):
        words = rows[5 * k + 1][1].split()
        add(words, "copy")
        if len(words) > 100:
            add([*words[:-1], "other"], "near")
    add(None, "clean"), add([], "copy"), add(["é", "日本"], "clean")
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, expect


def test_each_stage_drops_what_it_should(spark, corpus):
    folder, rows, expect = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = set(expect)
    drops = {"toxicity": {"toxic"}, "exact_dedup": {"copy"}, "near_dedup": {"near"}, "decontamination": {"leak"}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/after{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left - now == {i for i in left if expect[i] in drops[name]}, name
        left = now
    assert {expect[i] for i in left} == {"clean"}


def test_run_encodes_what_is_left(spark, corpus):
    folder, rows, expect = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {i for i, kind in expect.items() if kind == "clean"}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    text = dict(rows)
    assert all(list(r.ids) == library.encode_ordinary(text[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip for r in out)
