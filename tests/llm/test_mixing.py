import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from portolan.llm import mixing
from portolan.llm.common import table, unit_hash, written


def targets_by_hand(sizes):
    """Shares by weight; what is over three times a source's size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    draw = random.Random(seed)
    names = ["b", "a", "ä", "Z", None, "", "zz", "c"][:draw.randint(1, 8)]
    sizes = {n: draw.choice([0, 1, 10, 500, 10000]) for n in names}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.with_targets(rows).collect()}
    want = targets_by_hand(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in got)


def mixed(docs, **options):
    return mixing.mix_documents(docs, **options).collect()


def test_taken_words_come_near_the_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = defaultdict(int), {}
    first = mixed(docs)
    for r in first:
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(first) == len(source)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in first))
    off = [abs(taken[s] - target[s]) / target[s] for s in target]
    assert max(off) < 0.05 and sum(off) / len(off) < 0.01
    again = mixed(docs.repartition(7))
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_a_hot_source_and_a_huge_document(spark):
    """The tree is three levels deep, and one document has a fifth of a source's words."""
    n = mixing.BLOCK * mixing.BLOCK + 500
    sized = spark.range(n).select(
        F.col("id").alias("item"), F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("hot").alias("source"),
        F.when(F.col("id") == 1, 300000).otherwise(F.col("id") % 50 + 1).alias("size"),
        F.col("id").alias("content"))
    rows = mixing.copies(sized).collect()
    assert len(rows) == n
    by_target = defaultdict(int)
    for r in rows:
        by_target[(r.source_size, r.target)] += r["size"] * r.copies
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 60


def test_each_document_is_taken_as_often_as_its_chance(spark):
    """600 blocks of the same four documents: taken shares near their chances, words exact."""
    items = spark.range(2400).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / 4)).alias("source"), F.col("id").alias("item"),
        unit_hash(F.lit(3), "id").alias("draw"), F.element_at(F.array(*[F.lit(s) for s in (5, 20, 20, 80)]),
                                                   (F.col("id") % 4 + 1).cast("int")).alias("size"),
        F.lit(0.4).alias("p"))
    rows = mixing.round_chances(items).collect()
    assert len(rows) == 2400
    for k in range(4):
        share = sum(r.up for r in rows if r.item % 4 == k) / 600
        assert share == pytest.approx(0.4, abs=0.07)
    words = defaultdict(int)
    for r in rows:
        words[r.source] += r.up * r["size"]
    assert max(abs(w - 0.4 * 125) for w in words.values()) <= 80


def repeating(spark, n):
    """A third of the rows are one document's, some of them with another text, and a
    twelfth have no id."""
    i = F.col("id")
    doc_id = F.when(i % 3 == 0, 7).when(i % 12 == 1, None).otherwise(i + 10)
    text = F.when(i % 30 == 3, "another text").when((i % 3 == 0) | (i % 24 == 1), "one two").otherwise(
        F.repeat(F.lit("w "), (i % 40 + 1).cast("int")))
    return spark.range(n).select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"),
                                 F.concat(F.lit("s"), i % 2).alias("source"), i.alias("extra"))


@pytest.mark.parametrize("ranked", [mixing.RANKED, 50])
def test_reruns_agree_where_ids_repeat(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    docs = repeating(spark, 6000)
    first = Counter(map(tuple, mixed(docs.coalesce(1))))
    for other in (docs.repartition(5), docs.orderBy(F.desc("extra")), docs.repartition(3, "text")):
        assert Counter(map(tuple, mixed(other))) == first
    columns = ["doc_id", "text", "source"]
    taken = [Counter(map(tuple, mixing.take_mix(d).collect()))
             for d in (docs.select(*columns).coalesce(1), docs.select(*columns).repartition(5))]
    assert taken[0] == taken[1]
    words = Counter()
    for row, n in first.items():
        words[row[2], row[3]] += row[4] * n
    assert all(abs(taken - target) <= 41 for (_, target), taken in words.items())


def test_repeated_rows_are_one_item(spark):
    docs = repeating(spark, 3000)
    sized = docs.select(F.col("extra").alias("item"), "doc_id", "source", F.size(F.split(F.trim("text"), " "))
                        .cast("bigint").alias("size"), F.xxhash64("text").alias("content"))
    rows = mixing.copies(written(sized, "sized")).collect()
    assert sorted(r["item"] for r in rows) == list(range(3000))
    for target in {r.target for r in rows}:
        own = [r for r in rows if r.target == target]
        hot = [r.copies for r in own if r.doc_id == 7 and r["size"] == 2 and r["item"] % 30 != 3]
        share = sum(r.copies * r["size"] for r in own) / sum(r["size"] for r in own)
        assert len(hot) >= 400 and abs(sum(hot) - share * len(hot)) <= 1.5 and max(hot) - min(hot) <= 1


def test_many_sources_take_linear_time(spark):
    n = 60_000
    sources = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"),
                                    (F.col("id") % 1000).alias("source_size"))
    start = time.perf_counter()
    got = mixing.with_targets(sources).agg(
        F.count("*").alias("n"), F.sum("target").alias("target"), F.sum("source_size").alias("size")).first()
    assert got.n == n and got.target == pytest.approx(got["size"]) and time.perf_counter() - start < 60


def test_odd_documents(documents):
    rows = mixed(documents((1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x", "a"),
                           (5, "y z", "a"), (5, "y z", "a"), (6, "w " * 30000, "b")))
    assert len(rows) == 7
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert {r.source_size for r in rows if r.doc_id == 3} == {2}
    assert mixed(documents()) == []
    assert [r.taken for r in mixed(documents(None, ""))] == [0, 0]


def test_the_rows_taken_are_whole(documents):
    docs = documents((1, "a b", "x"), (2, "c d e", "x"), (3, "f", "y"), (3, "f", "y"), (4, "g " * 40, None))
    want = Counter()
    for r in mixed(docs):
        want[r.doc_id] += r.taken // r["size"]
    got = mixing.take_mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_no_python_runs(documents):
    docs = documents("a b c", "d")
    for df in (mixing.mix_documents(docs), mixing.take_mix(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
