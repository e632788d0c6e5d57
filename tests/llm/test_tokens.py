import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from portolan.llm import token_counts, token_files
from portolan.scratch import new_folder
from tests.llm.conftest import rows_of

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["hello  wörld", None, "", "tie", "tie", "日本 ▁x\n\n<s></s> ", "a" * 3000, "word " * 900]


# Token files

def files_of(spark, docs):
    folder = new_folder(spark, "tokens")
    shards = token_files.write_token_files(docs, folder, BYTES)
    return rows_of(token_files.read_token_files(spark, folder, shards)), folder, shards


def expected(texts):
    library, start, rows = tokenizers.Tokenizer.from_file(BYTES), 0, []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_token_files_round_trip(spark, documents):
    got, folder, shards = files_of(spark, documents(*TEXTS).repartition(5))
    assert got == expected(enumerate(TEXTS))
    assert {s.kind for s in shards.collect()} == {"u16"}
    assert sum(s.docs for s in shards.collect()) == len(TEXTS)


def test_shards_follow_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, _, shards = files_of(spark, docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 1
    assert got == expected(rows_of(docs, "doc_id", "text"))


def test_missing_and_repeated_ids(spark, documents):
    got, _, _ = files_of(spark, documents((None, "a", "s"), (-5, "b", "s"), (7, "c", "s"), (7, "c", "s")))
    assert [(r[0], r[1]) for r in got] == [(None, 0), (-5, 2), (7, 4), (7, 6)]


def test_no_documents_no_files(spark, documents):
    assert files_of(spark, documents().limit(0))[0] == []


# Prefix counts

@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text("abcdest  ▁\n\t.,éß日🙂01<s>/", max_size=60))
def test_every_prefix_counts_as_the_library_says(counter, library, text):
    want = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
    assert counter.counts(text).tolist() == want
    assert [len(s) for s in counter.steps([text])] == [len(text)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcdest é日.\n", max_size=40), max_size=12))
def test_words_of_a_group_share_prefixes(counter, library, texts):
    """Words are worked out together; cleared caches and small groups change nothing."""
    fresh = token_counts.PrefixCounter.__new__(token_counts.PrefixCounter)
    fresh.__dict__ = counter.__dict__ | {
        "_word_steps": {}, "_fits": {}, "_built": {}, "_kept_chars": token_counts.CACHED_CHARS + 1}
    want = [[len(library.encode(t[:n])) for n in range(len(t) + 1)] for t in texts]
    assert [token_counts.prefix_counts_of(s).tolist() for s in fresh.steps(texts)] == want
    assert [token_counts.prefix_counts_of(s).tolist() for s in counter.steps(iter(texts))] == want


def test_counts_of_real_texts(spark, sf_dir, counter, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert [counter.counts(t)[-1] for t in texts] == [len(ids) for ids in library.encode(texts)]


def test_counted_documents(documents, library):
    got = rows_of(token_counts.count_tokens(documents(*TEXTS), PIECES, (5,)),
                  "doc_id", "n_bytes", "n_tokens", "chars_within_5")
    for (i, n_bytes, n_tokens, chars), text in zip(got, TEXTS):
        text = text or ""
        assert (n_bytes, n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert len(library.encode(text[:chars])) <= 5
        assert chars == len(text) or all(
            len(library.encode(text[:n])) > 5 for n in range(chars + 1, min(len(text), chars + 20) + 1))


def test_questions_are_answered_from_stored_counts(documents, library):
    counted = token_counts.count_tokens(documents(*TEXTS[:6]), PIECES, (4,), keep_counts=True)
    for i, tokens in rows_of(token_counts.tokens_of_prefix(counted, 4)):
        assert tokens == len(library.encode((TEXTS[i] or "")[:4]))
    assert rows_of(token_counts.prefix_within(counted, 4)) == rows_of(
        counted, "doc_id", "chars_within_4")


def test_budgets_are_answered_without_the_texts(spark, documents, library, tmp_path, monkeypatch):
    """From what was stored: a byte per character, and no tokenizer at hand."""
    token_counts.store_counts(documents(*TEXTS), PIECES).write.parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    assert rows_of(stored.select("doc_id", F.length("steps"))) == [
        (i, len(t or "")) for i, t in enumerate(TEXTS)]
    for budgets in ((0,), (1, 3, 50)):
        got = token_counts.answers(stored, budgets).collect()
        for r in got:
            text = TEXTS[r.doc_id] or ""
            assert r.n_tokens == len(library.encode(text))
            for budget in budgets:
                chars = r[f"chars_within_{budget}"]
                assert len(library.encode(text[:chars])) <= budget
                assert all(len(library.encode(text[:n])) > budget
                           for n in range(chars + 1, min(len(text), chars + 20) + 1))


def test_no_documents_no_counts(documents):
    assert token_counts.count_tokens(documents(), PIECES).isEmpty()


def test_a_vocabulary_of_another_kind_is_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.PrefixCounter(BYTES)
