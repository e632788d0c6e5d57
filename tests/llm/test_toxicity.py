import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import toxicity
from portolan.llm.common import table
from tests.llm.conftest import rows_of


def test_scores_on_held_out_documents(spark, sf_dir):
    """Accuracy where labels were never learned from; documents of a tenth of the size
    that the model is made for."""
    folder = sf_dir.replace("sf0.01", "sf0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, labels)).where("held_out")
    rows = rows_of(scored.join(labels, "doc_id"), "score", "predicted", "toxic")
    right = sum(p == t for _, p, t in rows) / len(rows)
    toxic, clean = [s for s, _, t in rows if t], [s for s, _, t in rows if not t]
    ranked = np.mean([np.mean(np.array(clean) < s) + np.mean(np.array(clean) == s) / 2 for s in toxic])
    assert len(rows) > 500 and right > 0.96 and ranked > 0.93
    assert np.mean([p for _, p, t in rows if not t]) < 0.02


def texts_with_pairs(n, seed):
    """Toxic only where both words meet, which no sum of single weights says."""
    draw = random.Random(seed)
    filler = [f"w{i}" for i in range(30)]
    texts, labels = [], []
    for _ in range(n):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        words = draw.sample(filler, 6) + ["insult"] * a + ["group"] * b
        texts.append(toxicity.terms(" ".join(words)))
        labels.append(int(a and b))
    return texts, np.array(labels)


def test_pairs_are_learned():
    texts, labels = texts_with_pairs(1500, 1)
    model = toxicity.fit(texts, labels)
    new, wanted = texts_with_pairs(300, 2)
    assert np.mean([(model.score(t) >= 0.5) == w for t, w in zip(new, wanted)]) > 0.98
    term = toxicity.terms
    assert model.score(term("insult group")) > 0.5 > max(
        model.score(term("insult")), model.score(term("group")))
    assert np.abs(model.factors).max() > 0.1


def texts_of_cells(n, seed):
    """Ten insults, ten groups and much else. Each word alone is as toxic as any other;
    one group for each insult makes it so."""
    draw = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        insult, group = draw.randrange(10), draw.randrange(10)
        words = [f"w{draw.randrange(5000)}" for _ in range(30)] + [f"insult{insult}", f"group{group}"]
        texts.append(toxicity.terms(" ".join(words)))
        labels.append(int(draw.random() < (0.95 if insult == group else 0.01)))
    return texts, np.array(labels)


def ranked(scores, labels):
    toxic, clean = scores[labels == 1], np.sort(scores[labels == 0])
    return np.mean(np.searchsorted(clean, toxic) / len(clean))


def test_pairs_of_words_that_tell_nothing_alone():
    texts, labels = texts_of_cells(20_000, 3)
    model = toxicity.fit(texts, labels)
    new, wanted = texts_of_cells(3000, 4)
    both = ranked(np.array([model.score(t) for t in new]), wanted)
    weights = toxicity.FactorizationMachine(model.bias, model.weights, np.zeros_like(model.factors))
    alone = ranked(np.array([weights.score(t) for t in new]) + 1e-9 * np.random.default_rng(0).random(
        len(new)), wanted)
    assert both > 0.9 > 0.6 > alone


def test_terms_in_all_are_bounded(spark, documents):
    docs = documents(*[(i, " ".join(f"t{i}x{j}" for j in range(50)), "s") for i in range(1, 40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    taken = toxicity.bounded_sample(docs, labels, most_terms=300)
    assert taken.rdd.getNumPartitions() == 1
    assert 250 < sum(len(r.terms) for r in taken.collect()) <= 300


def test_the_model_is_that_of_the_sample_in_its_order(spark, documents):
    docs = documents(*[(i, f"w{i % 7} u{i % 3} " + ("insult group" if i % 5 == 0 else "insult"), "s")
                       for i in range(300)])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)],
                                   "doc_id bigint, quality int, toxic int")
    rows = toxicity.bounded_sample(docs, labels).collect()
    want = toxicity.fit([np.array(r.terms, np.int32) for r in rows], np.array([r.label for r in rows]))
    got = toxicity.learn(docs.repartition(5), labels)
    assert got.bias == want.bias
    assert (got.weights == want.weights).all() and (got.factors == want.factors).all()
    empty = toxicity.learn(docs.where("false"), labels)
    assert empty.score(toxicity.terms("a b")) == pytest.approx(0.5)


def test_a_model_without_both_labels_gives_their_share():
    assert toxicity.fit([], np.array([])).score(toxicity.terms("a b")) == pytest.approx(0.5)
    texts = [toxicity.terms(t) for t in ("a", "b", "c")]
    assert toxicity.fit(texts, np.zeros(3)).score(texts[0]) == pytest.approx(0.125)


def test_held_out_rows_and_labels_are_not_learned_from(spark, documents):
    docs = documents(*[(i, f"text {i}", "s") for i in range(50)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(3, 1, None), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    rows = rows_of(toxicity.training_rows(docs, labels), "doc_id", "label")
    fold = {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, _ in rows} == set(range(50)) - fold
    assert all(label == i % 2 for i, label in rows)
    assert toxicity.training_rows(docs, labels, 10).count() == 10


def test_scores_of_odd_texts(spark, documents):
    model = toxicity.fit([toxicity.terms(t) for t in ("bad word", "good word")] * 8,
                         np.array([1, 0] * 8))
    got = toxicity.score_documents(documents(None, "", "bad", "bad", "x " * 20000, (None, "a", "s")), model)
    rows = {(r.doc_id, r.held_out, r.score, r.predicted) for r in got.collect()}
    assert len(rows) == 6 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, _, s, p in rows)
    assert {h for i, h, _, _ in rows if i is None} == {True}
    assert toxicity.score_documents(documents(), model).isEmpty()


def test_scores_read_the_text_alone(documents):
    model = toxicity.fit([], np.array([]))
    docs = documents("a").withColumn("doc_id", F.lit(3))
    plan = toxicity.score_documents(docs, model)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_the_kept_rows_are_whole(documents):
    texts = ["insult group"] * 30 + ["plain words"] * 30
    model = toxicity.fit([toxicity.terms(t + f" x{i}") for i, t in enumerate(texts)],
                         np.array([1] * 30 + [0] * 30))
    docs = documents(None, "", "insult group", "plain words", "plain words")
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = {i for i, t in enumerate(("", "", "insult group", "plain words", "plain words"))
            if model.score(toxicity.terms(t)) < 0.5}
    assert {r.doc_id for r in kept.collect()} == want and 2 not in want and {3, 4} <= want
    assert {r.component for r in kept.collect()} == {"x"}
