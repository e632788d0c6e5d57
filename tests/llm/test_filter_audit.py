"""Filter interactions, against removing documents filter by filter."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from portolan.llm import filter_audit
from tests.llm.conftest import rows_of

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
           "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id bigint, quality int, toxic int, text string, n string, part string"


def fails_of(rows):
    """The filters each row fails, by their wording."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        yield "".join(name for name, fails in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text),
            doc_id is not None and doc_id > least.get(text, doc_id))) if fails)


def brute(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, toxic in labels if toxic == 1}
    parts = {}
    for (doc_id, _, source), fails in zip(rows, fails_of(rows)):
        parts.setdefault(source or "", []).append((doc_id, fails))
    found = []
    for part, own in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone),
                              sum(name in fails for _, fails in own) - len(gone),
                              sum(fails == name for _, fails in own),
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name))
        found += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(found)


def check(spark, documents, rows, labels):
    marks = spark.createDataFrame([(*row, "x", "x", "x") for row in labels], LABELS)
    got = filter_audit.audit(documents(*rows), marks)
    assert got.columns == list(COLUMNS)
    assert rows_of(got) == brute(rows, labels)


def long(n, extra=""):
    return " ".join(f"w{i}" for i in range(n)) + extra


def test_every_order_removes_what_applying_it_removes(spark, documents):
    rows = [
        (0, long(200), "a"), (1, long(200), "a"), (2, long(200), "b"), (3, long(199), "a"),
        (4, " ".join(["same"] * 300), "a"), (5, "SHOUT " * 200, "b"), (6, long(250, " 5 %"), "a"),
        (7, "A# b", "b"), (8, "A# b", "a"), (9, "", "a"), (10, None, None), (11, "", ""),
        (12, "x y z", "a"), (13, long(30_000, "É" * 50), "c"), (14, long(400, " A" * 40), "c")]
    check(spark, documents, rows, [(0, 1, 0), (1, 1, 1), (4, 0, 1), (5, None, None), (99, 1, 1)])


def test_the_limits_are_as_stated():
    def fails(text):
        return "".join(n for i, n in enumerate("ABCD") if filter_audit.own_failures(text.encode()) >> i & 1)
    assert fails(long(200)) == "" and fails(long(199)) == "A"
    assert fails(long(100) + " w0" * 100) == "" and fails(long(100) + " w0" * 101) == "B"
    assert fails("é" * 49 + "A") == "A" and fails("é" * 48 + "A") == "AC"
    assert fails("") == "A" and fails("|") == "AD"


def test_nulls_ties_and_repeated_rows(spark, documents):
    rows = [(5, long(210), "a"), (5, long(210), "a"), (None, long(210), "a"), (None, long(210), "b"),
            (3, None, "a"), (3, "", "b"), (3, "x", "b"), (7, "x", None), (5, long(210), "b")]
    check(spark, documents, rows, [(5, 0, 0), (5, 1, None), (3, 1, 1), (None, 1, 1), (7, None, 1)])


def test_a_text_that_most_rows_share_is_counted_before_the_shuffle(spark, documents):
    rows = [(i, "copy", "s" if i % 3 else "t") for i in range(300)]
    check(spark, documents, rows, [(i, i % 2, 1) for i in range(0, 300, 3)])


def test_no_documents_give_no_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1, "x", "x", "x")], LABELS)
    assert filter_audit.audit(documents((1, "a", "s")).limit(0), labels).isEmpty()
    check(spark, documents, [(1, "a", "s")], [])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_intervals_are_the_orders_that_remove_at_a_step(n):
    covered = Counter()
    for mask, step, first, end in filter_audit.removal_intervals(n):
        for rank in range(first, end):
            covered[mask, rank] += step
    wanted = {(mask, rank): next(i for i, f in enumerate(order, 1) if mask >> f & 1)
              for mask in range(1, 1 << n) for rank, order in enumerate(permutations(range(n)))}
    assert covered == wanted


def test_the_order_of_rows_and_partitions_does_not_matter(spark, documents):
    rows = [(i, long(190 + i % 20, " #" if i % 4 == 0 else ""), f"s{i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0, "x", "x", "x") for i in range(0, 60, 2)], LABELS)
    docs = documents(*rows)
    assert rows_of(filter_audit.audit(docs, labels)) == rows_of(filter_audit.audit(
        docs.orderBy(F.desc("doc_id")).repartition(5), labels))
