import random
import re

import pytest

from portolan.llm import host_rules
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words, places = WORD.findall(text), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


def odd_texts():
    draw = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b c a b c", "a a a a", "x\n x\nx\nx\n\n\n \n", "é🙂 #*$%&|<>",
             "a\x1cb\xa0c d", "one two", "line\r\nline\r\nline\n", "w " * 30000, "a b " * 10000]
    texts += [" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 90))) for _ in range(150)]
    texts += ["".join(draw.choice("ab \n\t#é") for _ in range(draw.randint(0, 200))) for _ in range(80)]
    return texts


def test_measures_against_brute_force(documents):
    texts = odd_texts()
    got = rows_of(host_rules.judge_documents(documents(*texts)), "doc_id", *host_rules.MEASURES,
                  "base_failed")
    assert [r[1:] for r in got] == [by_hand(t) for t in texts]


def rates(counts):
    """The documented formula, host by host: (docs, failures) -> rate."""
    docs, failures = sum(d for d, _ in counts.values()), sum(f for _, f in counts.values())
    m = failures / docs
    spread = sum(f * f / d for d, f in counts.values()) / docs - m * m
    chance = len(counts) * m * (1 - m) / docs
    if spread - chance <= 0:
        return dict.fromkeys(counts, m)
    k = max(0.0, m * (1 - m) / (spread - chance) - 1)
    return {h: (f + k * m) / (d + k) for h, (d, f) in counts.items()}


GOOD = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("counts", [
    {"a": (40, 2), "b": (40, 38), "c": (30, 1), None: (5, 4)},
    {"a": (3, 3), "b": (200, 5), "c": (100, 4)},
    {"a": (10, 0), "b": (10, 0)}, {"a": (10, 10)}, {"a": (1, 0), "b": (1, 1)}])
def test_host_verdicts(documents, counts):
    rows, wanted, rate = [], {}, rates(counts)
    for host, (docs, failures) in counts.items():
        for i in range(docs):
            wanted[len(rows)] = i >= failures and rate[host] <= 0.5
            rows.append((len(rows), "short" if i < failures else GOOD, host))
    docs = documents(*rows)
    judged = host_rules.judge_documents(docs)
    got = {r.doc_id: (r.kept, r.host_rate) for r in judged.collect()}
    assert {i: kept for i, (kept, _) in got.items()} == wanted
    for i, _, host in rows:
        assert got[i][1] == pytest.approx(rate[host])
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in wanted.items() if k}


def test_a_bad_host_takes_its_documents_with_it(documents):
    rows = [(i, GOOD if i % 20 == 0 else "bad", "bad") for i in range(100)]
    rows += [(100 + i, GOOD, "good") for i in range(100)]
    judged = {r.doc_id: r.kept for r in host_rules.judge_documents(documents(*rows)).collect()}
    assert not any(judged[i] for i in range(100)) and all(judged[i] for i in range(100, 200))


def test_clean_documents_of_mixed_hosts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = host_rules.judge_documents(docs).collect()
    assert all(r.kept != r.base_failed for r in rows)


def test_repeats_and_nothing(documents):
    assert host_rules.judge_documents(documents()).isEmpty()
    assert host_rules.keep_good(documents()).isEmpty()
    assert host_rules.judge_documents(documents((1, GOOD, "a"), (1, GOOD, "a"))).where("kept").count() == 2


def test_no_python_runs(documents):
    for df in (host_rules.judge_documents(documents("a")), host_rules.keep_good(documents("a"))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
