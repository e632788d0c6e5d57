"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import dimension_scan
from portolan.llm.queries import op13_dimension_scan
from tests.llm.conftest import rows_of

CLASHING = ["q", "size", "list", "block", "place", "vector", "copy", "best", "rank", "score", "_q", "length"]


@pytest.fixture(scope="module")
def embeddings(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns(
            {name: F.lit("x") for name in CLASHING})
    return make


def searched(vectors, every=100, k=10):
    index = dimension_scan.build(vectors, k=k)
    queries = vectors.where(F.col("vec_id") % every == 0)
    return dimension_scan.nearest(index, queries, k=k)


def brute(rows, every=100, k=10):
    """(query, [(distance, id)]) of each usable query, as the contract words it."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None
              and None not in v and np.isfinite(v).all() and any(v)}
    usable = [(i, np.array(v, np.float64)) for i, v in sorted(usable)]
    found = []
    for place, (i, query) in enumerate(usable):
        if i % every == 0:
            near = sorted((float(np.sqrt(np.square(query - v).sum())), j)
                          for other, (j, v) in enumerate(usable)
                          if other != place and len(v) == len(query))
            found.append((i, near[:k]))
    return found


def check(got, rows, every=100, k=10, recall=1.0):
    wanted = brute(rows, every, k)
    held = {}
    for q, rank, i, score in rows_of(got, "query_id", "rank", "vec_id", "score"):
        held.setdefault(q, []).append((rank, score, i))
    assert set(held) == {q for q, near in wanted if near}
    hits = total = 0
    distance = {}
    for q, near in wanted:
        own = held.get(q, [])
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        hits += len({i for _, i in near} & {i for _, _, i in own})
        total += len(near)
    for i, v in rows:
        distance[i] = np.array(v, np.float64) if v is not None and None not in v else None
    for q, own in held.items():
        for _, score, i in own:
            assert score == pytest.approx(np.sqrt(np.square(distance[q] - distance[i]).sum()), rel=1e-12)
    assert hits >= recall * total
    return hits / total


def test_recall_on_the_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op13_dimension_scan(spark, sf_dir)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    check(got, rows, recall=0.95)


def test_recall_on_clusters_and_scattered_vectors(embeddings):
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 48))
    rows = np.concatenate([centres[random.integers(0, 40, 6000)] + 0.2 * random.normal(size=(6000, 48)),
                           random.normal(size=(2000, 48)),
                           centres[0] + 0.01 * random.normal(size=(4000, 48))]).astype(np.float32)
    rows = [(i, v) for i, v in zip(random.permutation(len(rows)).tolist(), rows.tolist())]
    check(searched(embeddings(rows)), rows, recall=0.95)


def test_a_vector_that_a_third_of_all_rows_share(embeddings):
    random = np.random.default_rng(2)
    rows = random.normal(size=(1500, 20)).astype(np.float32)
    rows[random.permutation(1500)[:500]] = rows[0]
    rows = list(enumerate(rows.tolist()))
    index = dimension_scan.build(embeddings(rows))
    assert index.blocks.agg(F.sum(F.size("ids"))).first()[0] == len({tuple(v) for _, v in rows}) + 10
    got = searched(embeddings(rows))
    check(got, rows, recall=0.95)
    copies = [i for i, v in rows if v == rows[0][1]]
    for q in [i for i in copies if i % 100 == 0]:
        own = got.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.vec_id for r in own] == [i for i in copies if i != q][:10]
        assert {r.score for r in own} == {0.0}


def test_vectors_without_a_use_take_no_part(embeddings):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [0.0, 0.0]), (300, [1.0, None]),
            (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 2.0]), (7, []),
            (8, [1.0, 2.0]), (9, [2.0, 2.0]), (600, [5.0, 5.0, 5.0]), (11, [5.0, 5.0, 4.0]),
            (700, [1.0])]
    got = searched(embeddings(rows))
    assert rows_of(got) == [(0, 1, 8, 0.0), (0, 2, 9, 1.0), (600, 1, 11, 1.0)]


def test_rows_that_repeat_id_and_vector_are_one(embeddings):
    rows = [(0, [1.0, 0.0])] * 30 + [(0, [1.0, 1.0])] * 3 + [(5, [1.0, 0.0]), (4, [1.0, 2.0])] * 2
    got = rows_of(searched(embeddings(rows)))
    assert got == [(0, 1, 0, 1.0), (0, 1, 5, 0.0), (0, 2, 0, 1.0), (0, 2, 4, 1.0),
                   (0, 3, 4, 2.0), (0, 3, 5, 1.0)]


def test_ties_go_to_the_smaller_id(embeddings):
    rows = [(100, [0.5, 0.5])] + [(i, [0.5 + (i % 2 or -1), 0.5]) for i in range(1, 40)]
    got = searched(embeddings(rows, "double"), k=4)
    assert rows_of(got) == [(100, r, r, 1.0) for r in range(1, 5)]


@pytest.mark.parametrize("kind,scale", [("double", 1e200), ("double", 1e-30), ("float", 1e30)])
def test_very_large_and_small_components(embeddings, kind, scale):
    random = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((scale * random.normal(size=(300, 40))).tolist())]
    if kind == "float":
        rows = [(i, np.float32(v).tolist()) for i, v in rows]
    if scale == 1e200:  # squares overflow: all are infinitely far, the smallest ids are nearest
        got = rows_of(searched(embeddings(rows, kind)))
        assert [r[:2] for r in got] == [(q, n) for q in (0, 100, 200) for n in range(1, 11)]
    else:
        check(searched(embeddings(rows, kind)), rows, recall=0.9)


def test_no_vectors_and_no_queries_give_no_rows(embeddings):
    some = embeddings([(1, [1.0, 2.0]), (2, [1.0, 3.0])])
    assert searched(some).isEmpty()
    assert searched(some.limit(0)).isEmpty()
    assert searched(embeddings([(100, [1.0, 2.0])])).isEmpty()


def test_long_lists_and_many_queries_are_cut(embeddings, monkeypatch):
    random = np.random.default_rng(4)
    rows = list(enumerate(random.normal(size=(900, 24)).astype(np.float32).tolist()))
    whole = rows_of(searched(embeddings(rows), every=10))
    monkeypatch.setattr(dimension_scan, "MOST_VALUES", 1000)
    monkeypatch.setattr(dimension_scan, "MOST_QUERIES", 8)
    cut = searched(embeddings(rows), every=10)
    check(cut, rows, every=10, recall=0.95)
    assert len(set(whole) & set(rows_of(cut))) > 0.9 * len(whole)


def test_the_scan_abandons_candidates_and_loses_few():
    random = np.random.default_rng(5)
    rows = random.normal(size=(4000, 128)).astype(np.float32)
    queries = rows[:50] + 0.5 * random.normal(size=(50, 128)).astype(np.float32)
    rotation = np.linalg.qr(random.normal(size=(128, 128)))[0]
    turned, own = (dimension_scan._turned(x, rotation) for x in (queries, rows))
    columns = [own[:, at:at + 16].T for at in range(0, 128, 16)]
    away = np.sqrt(np.square(queries[:, None].astype(np.float64) - rows[None]).sum(axis=2))
    beat = 1.1 * np.sort(away, axis=1)[:, 9]
    query, row, distance = dimension_scan.scan(queries, turned, beat, rows, columns, 10)
    within = int((away <= beat[:, None]).sum())
    assert 0.98 * within <= len(query) <= within
    wanted = {(q, r) for q in range(50) for r in np.argsort(away[q])[:10].tolist()}
    assert len(wanted & set(zip(query.tolist(), row.tolist()))) >= 0.98 * len(wanted)
    assert np.allclose(distance, away[query, row], rtol=1e-12)
