"""Registered queries against their SQL, and the pipeline stage by stage."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers

import __spark_entry__ as contract
import corpus_pipeline
from portolan.llm import host_rules
from portolan.llm.common import table, written
from portolan.llm.oracles import ORACLES
from portolan.llm.queries import QUERIES

SAME_TYPE = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
             "BOOLEAN": "boolean"}
NATIVE = ("op4_", "op5_", "op7_")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_all_are_registered():
    assert QUERIES.items() <= contract.queries().items()
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert ORACLES.items() <= contract.oracle_sql().items()
    assert sorted({name.split("_")[0] for name in QUERIES}) == sorted(f"op{n}" for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name])
    columns = {c[0]: i for i, c in enumerate(want.description)}
    order = sorted(got.columns)
    assert sorted(columns) == order
    assert {c: SAME_TYPE[str(want.description[columns[c]][1])] for c in order} == dict(got.dtypes)
    expected = Counter(tuple(row[columns[c]] for c in order) for row in want.fetchall())
    assert Counter(map(tuple, got.select(*order).collect())) == expected


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(NATIVE)))
def test_native_queries_run_no_python(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        kept.append(docs.collect())
    quality, civil, single, mixed, packed = kept
    for rows in kept[:-1]:
        assert list(rows[0].asDict()) == columns
        assert all(r == before[r.doc_id] for r in rows)

    failed = {r.doc_id for r in host_rules.judge_documents(table(spark, sf_dir, "documents")).collect()
              if not r.kept}
    assert sorted(r.doc_id for r in quality) == sorted(before.keys() - failed)

    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    gone = {r.doc_id for r in quality} - {r.doc_id for r in civil}
    assert gone and np.mean([toxic.get(i, 1) for i in gone]) > 0.8
    assert np.mean([toxic.get(r.doc_id, 0) for r in civil]) < 0.06

    texts = Counter(r.text for r in single)
    assert set(texts.values()) == {1} and texts.keys() <= {r.text for r in civil}
    by_text = defaultdict(list)
    for r in civil:
        by_text[r.text].append(r.doc_id)
    assert sum(len(v) for v in by_text.values()) > len(single) > 0.9 * len(by_text)
    assert all(r.doc_id == min(by_text[r.text]) for r in single)

    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and times.keys() <= {r.doc_id for r in single}
    size = {r.doc_id: len(r.text.split()) for r in single}
    words = sum(size[i] * n for i, n in times.items())
    assert words == pytest.approx(sum(size.values()), rel=0.02)

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum((len(library.encode(before[i].text).ids) + 1) * n for i, n in times.items())
    assert sum(r.length for r in packed) == tokens
    assert tokens > 0.98 * 2048 * len({r.sequence_id for r in packed})


def test_the_pipeline_runs_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert "doc_id" in rows.columns and rows.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "toxicity", "near_duplicates", "mixed_sources", "packed"]


def test_stages_take_empty_documents(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert written(stage(spark, empty, sf_dir), name).isEmpty()
    assert corpus_pipeline.packed(spark, empty, sf_dir).isEmpty()
