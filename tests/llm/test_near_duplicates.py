import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from portolan.llm import components, pivot_index, simhash
from tests.llm.conftest import rows_of


def groups(nodes, pairs):
    """Node -> smallest node it reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Components

@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)],
    [(0, i) for i in range(1, 60)], [(60, i) for i in range(60)],
    [(random.Random(4).randrange(90), random.Random(i).randrange(90)) for i in range(60)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert rows_of(components.components(df)) == sorted(groups(nodes, [p for p in links]).items()
                                                        if nodes else [])


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
def test_spanning_links(pairs):
    left, right = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    kept = components.spanning_links(left, right, list(range(13)))
    assert len(kept) <= 12
    assert groups(range(13), [pairs[i] for i in kept]) == groups(range(13), pairs)


# SimHash

def by_hand(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if (
        len(words) >= size) else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200)
@given(st.text("aB Éx\n\t\x0b\x1c\xa0z.", max_size=60))
def test_fingerprints_against_brute_force(text):
    assert simhash.fingerprint(text)[0] % (1 << 64) == by_hand(text)


def near_texts(seed=9):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice([3, 60, 300]))] for _ in range(60)]
    texts = [None, "", " ", "a", "A", "one two three", "One  two\nthree"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            edited = list(words)
            edited[draw.randrange(len(edited))] = "edit"
            texts.append(" ".join(edited))
    return texts


def test_linked_documents_against_brute_force(documents):
    texts = near_texts()
    prints = [by_hand(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert len({frozenset(p) for p in pairs if prints[p[0]] != prints[p[1]]}) > 10
    got = simhash.near_duplicates(documents(*texts))
    wanted = groups(range(len(texts)), pairs)
    assert [(r[0], r[1]) for r in rows_of(got, "place", "component")] == sorted(wanted.items())
    digits = {r.place: r.d for r in got.select("place", simhash.hex_digits(F.col("print")[0]).alias("d")).collect()}
    assert digits == {i: f"{p:016x}" for i, p in enumerate(prints)}


def flipped(value, bits):
    for bit in bits:
        value ^= 1 << bit
    return value - ((value >> 63) << 64)


@pytest.mark.parametrize("scheme", [simhash.CLOSE, simhash.Scheme(5, 1, 24, 2, 2)])
@pytest.mark.parametrize("per_bucket", [1 << 19, 1 << 6])
def test_every_pair_within_the_radius_is_found(spark, scheme, per_bucket):
    """Chains at every distance up to the radius, and just beyond it, at few and many buckets."""
    draw, prints = random.Random(1), []
    for distance in range(scheme.radius + 2):
        for _ in range(40):
            value = draw.getrandbits(scheme.width)
            prints += [flipped(value, []), flipped(value, draw.sample(range(scheme.width), distance))]
    prints = list(dict.fromkeys(prints))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2)
             if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= scheme.radius]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(prints)], "id bigint, print array<bigint>")
    found = rows_of(simhash.links(df, scheme, per_bucket))
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
    assert groups(range(len(prints)), found) == groups(range(len(prints)), pairs)


def test_a_cluster_sends_few_links_from_many_buckets(spark):
    """2000 fingerprints all within 4 bits of each other: no pair but what connects them."""
    prints = [flipped(12345, bits) for n in range(3) for bits in itertools.combinations(range(64), n)]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(prints)], "id bigint, print array<bigint>")
    found = simhash.links(df).distinct()
    assert len(set(groups(range(len(prints)), rows_of(found)).values())) == 1
    assert found.count() < 40 * len(prints)


def test_one_row_of_each_group(documents):
    text = " ".join(f"w{i}" for i in range(100))
    docs = documents((5, text, "a"), (3, text, "b"), (3, text, "c"), (None, text, "d"), (9, "other", "e"),
                     (None, None, "f"), (8, "", "g"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in kept.collect()) == [(3, "b"), (8, "g"), (9, "e")]
    assert simhash.one_of_each(documents()).isEmpty()
    assert simhash.near_duplicates(documents()).isEmpty()


def test_missing_and_repeated_ids(documents):
    docs = documents((None, "a b", "s"), (None, "a b", "s"), (4, "a b", "s"), (4, "a b", "s"), (None, "z", "s"))
    assert rows_of(simhash.near_duplicates(docs), "place", "component") == [
        (None, None), (None, 4), (None, 4), (4, 4), (4, 4)]


# Pivot index

def unit(vectors):
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def clustered(n, size, seed):
    """Vectors at all cosines around the limit, in clusters, with copies."""
    random_ = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = random_.normal(size=size)
        rows.append(centre)
        for _ in range(random_.integers(0, 12)):
            noise = random_.normal(size=size) * np.linalg.norm(centre) / np.sqrt(size)
            rows.append(centre + noise * random_.choice([0, 0.05, 0.15, 0.25, 0.33, 0.4]))
    return np.array(rows[:n], np.float32)


def brute(vectors, least=0.95):
    """(i, j) pairs by cosine in double precision."""
    rows = unit(vectors.astype(np.float64))
    left, right = np.nonzero(np.triu(rows @ rows.T >= least, 1))
    return list(zip(left.tolist(), right.tolist()))


@pytest.mark.parametrize("most_list", [pivot_index.MOST_LIST, 40])
def test_recall_against_brute_force(spark, most_list):
    """With and without blocks of long lists: nothing wrong is linked, and of what is to
    be linked nine tenths at least."""
    vectors = clustered(3000, 24, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                               "vec_id bigint, embedding array<float>")
    got = {r.place: (r.n_links, r.component)
           for r in pivot_index.near_duplicates(df, most_list=most_list).collect()}
    pairs, links = brute(vectors), defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert all(got[i][0] <= links[i] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(links.values()) > 3000
    whole = groups(range(3000), pairs)
    assert sum(got[i][1] == whole[i] for i in got) >= 0.95 * 3000


@pytest.mark.parametrize("least_pivots", [pivot_index.LEAST_PIVOTS, 700])
def test_recall_in_a_hot_cluster(spark, monkeypatch, least_pivots):
    """A third of the distinct vectors about one centre, any two just above the limit."""
    monkeypatch.setattr(pivot_index, "LEAST_PIVOTS", least_pivots)
    random_, n = np.random.default_rng(7), 3600
    hot = random_.normal(size=64) + 0.21 * random_.normal(size=(n // 3, 64))
    cold = random_.normal(size=(n // 3, 64))
    near = cold + 0.25 * random_.normal(size=cold.shape)
    vectors = np.concatenate((hot, cold, near)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                               "vec_id bigint, embedding array<float>")
    got = {r.place: r.n_links for r in pivot_index.near_duplicates(df).collect()}
    links = np.bincount(np.array(brute(vectors)).ravel(), minlength=n)
    assert all(got[i] <= links[i] for i in got)
    for part in (slice(0, n // 3), slice(n // 3, n)):
        assert sum(got[i] for i in range(n)[part]) >= 0.95 * links[part].sum() > 1000


@pytest.mark.parametrize("mean_cosine", [0.6, 0.8])
def test_vectors_that_lean_one_way(spark, mean_cosine):
    """As text embeddings do: pivots are still many, and pairs just above the limit found."""
    random_, n = np.random.default_rng(11), 3000
    lean = np.sqrt(mean_cosine / (1 - mean_cosine))
    own = np.concatenate((random_.normal(size=(n, 64)) / 8, np.full((n, 1), lean)), axis=1)
    near = own[::3] + np.concatenate((random_.normal(size=(n // 3, 64)) / 8 * (
        0.3 * np.sqrt(1 + lean * lean)), np.zeros((n // 3, 1))), axis=1)
    vectors = unit(np.concatenate((own, near))).astype(np.float32)
    sample = unit(own)[:500]
    assert abs((sample @ sample.T).mean() - mean_cosine) < 0.05
    assert len(pivot_index._spread(unit(own), 100)) == 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                               "vec_id bigint, embedding array<float>")
    got = {r.place: r.n_links for r in pivot_index.near_duplicates(df).collect()}
    links = np.bincount(np.array(brute(vectors)).ravel(), minlength=len(vectors))
    assert all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.9 * links.sum() > 500


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]),
            (11, [-1.0, -2.0]), (None, [1.0, 2.0]), (12, [1e300, 2e300]), (13, [3.0]), (14, [0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns(
        {n: F.lit("x") for n in ("place", "vector", "copies", "size", "near")})
    got = rows_of(pivot_index.near_duplicates(df))
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11)]
    linked = [(None, 5, 7)] + [(i, 5, 7) for i in (7, 8, 9, 9, 12)]
    assert sorted(got, key=str) == sorted([*alone, *linked, (13, 1, 13), (14, 1, 13)], key=str)
    assert pivot_index.near_duplicates(df.limit(0)).isEmpty()


def test_copies_are_never_expanded(spark):
    """5000 copies of one vector and a near one: counted, not paired."""
    df = spark.range(5001).select(F.col("id").alias("vec_id"), F.when(
        F.col("id") < 5000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(
        F.array(F.lit(1.0), F.lit(0.1))).alias("embedding"))
    got = pivot_index.near_duplicates(df)
    assert {tuple(r) for r in got.select("n_links", "component").distinct().collect()} == {(5000, 0)}
