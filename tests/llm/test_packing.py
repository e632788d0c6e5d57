import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st

from portolan.llm import byte_bpe, packing
from portolan.llm.byte_bpe import ByteBpe
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return ByteBpe(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("ab 'st\t\n\r\x0b\x1c\x85\xa0.,!½²ªµßé×÷Ǿ01_|<>endoftext"))
def test_words_encode_as_the_whole_text_does(encoder, library, text):
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_character_below_the_limit(encoder, library):
    for code in range(0x251):
        for text in (f"a{chr(code)}b", f" {chr(code)} 1{chr(code)}", f"{chr(code)}{chr(code)}x'{chr(code)}"):
            assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings_are_handled_as_by_the_library(encoder, library):
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftex|>"):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


class Counted:
    """A tokenizer, and how often it was called to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.tokenizer, name)


def test_words_are_asked_once_and_many_at_a_time(library, monkeypatch):
    """Also when the cache is full: else rare words cost most of the time."""
    monkeypatch.setattr(byte_bpe, "CACHED_WORDS", 0)
    encoder = ByteBpe(PATH)
    encoder.tokenizer = whole = Counted(encoder.tokenizer)
    encoder.of_words = of_words = Counted(getattr(encoder, "of_words", None))
    text = "".join(f" q{chr(97 + i // 26)}{chr(97 + i % 26)}z" for i in range(500)) * 3
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert whole.calls + of_words.calls <= 500 / 100 + 1


def test_texts_taken_together_are_encoded_apart(library, encoder, monkeypatch):
    """Whatever ends one text and begins the next, and however many are taken together."""
    texts = ["it'", "s", " ", " a", "", None, "\n", "\n", "b'l", "l", "don't ", " 're", "'ve", "½", "1",
             "日本 x", "é", "<|endoftext|>", "<|", "endoftext|>", "'", "'", "", "a  "]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for at_once in (1, 10, 1 << 20):
        monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
        for kind in (pa.string(), pa.large_string()):
            array = pa.array(texts, kind)
            assert [ids.tolist() for ids in encoder.encode_all(array)] == want
            assert [ids.tolist() for ids in encoder.encode_all(array.slice(2, 9))] == want[2:11]
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []


@settings(max_examples=100, deadline=None)
@given(st.text("ab 'st\n.1½é", max_size=60), st.integers(1, 9))
def test_long_texts_go_in_pieces(encoder, library, text, size):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(byte_bpe, "AT_ONCE", size)
        assert "".join(byte_bpe._pieces(text)) == text
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 100), max_size=40), st.booleans())
def test_windows_hold_every_item_once(sizes, cut):
    windows = packing.pack_sizes(sizes, 100, cut)
    got = defaultdict(list)
    for window in windows:
        assert sum(length for _, _, length in window) <= 100
        for item, start, length in window:
            got[item].append((start, length))
    for item, size in enumerate(sizes):
        at = 0
        for start, length in sorted(got[item]):
            assert start == at and length > 0
            at += length
        assert at == size
        assert cut or len(got[item]) == 1
    if cut:
        assert len(windows) == -(-sum(sizes) // 100)


def test_differencing_gives_near_equal_sums():
    random.seed(3)
    sizes = [random.randint(1, 200) for _ in range(300)]
    windows = packing.differencing(sizes, 20)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(300))
    assert len(sums) == 20 and max(sums) - min(sums) <= 10  # of 1558 on average
    assert packing.differencing([8, 7, 6, 5, 4], 2) and packing.differencing([], 3) == []


def test_the_count_rises_while_the_capacity_is_exceeded():
    # 3 items of 60 need 3 windows of 100, though their sum fits 2.
    assert len(packing.pack_sizes([60, 60, 60], 100, cut=False)) == 3
    assert len(packing.pack_sizes([60, 60, 60], 100)) == 2


def test_packed_documents(spark, documents, library):
    texts = [None, "", "", "one two", "long " * 700, "x" * 5000, "tie", "tie", "wörd ✓ <|endoftext|>"]
    windows = packing.pack_documents(documents(*texts), PATH, 128, group_windows=3)
    pieces = defaultdict(list)
    for w in windows.collect():
        ids = np.frombuffer(w.tokens, "<u4")
        assert len(ids) == w.n_tokens <= 128
        assert sorted(p.offset for p in w.pieces) == [p.offset for p in w.pieces]
        assert sum(p.length for p in w.pieces) == w.n_tokens
        for p in w.pieces:
            pieces[p.doc_id].append((p.start, ids[p.offset:p.offset + p.length].tolist(), p.doc_tokens))
    for i, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[i])
        assert [start for start, _, _ in got] == list(np.cumsum([0] + [len(p) for _, p, _ in got])[:-1])
        assert [t for _, part, _ in got for t in part] == want
        assert {n for _, _, n in got} == {len(want)}
    digests = packing.pieces_of(windows).collect()
    assert {r.ids_crc32 for r in digests if r.doc_id == 3} == {zlib.crc32(np.array(
        [*library.encode("one two").ids, 1], "<u4").tobytes())}
    assert len({(r.sequence_id, r.offset) for r in digests}) == len(digests)


def test_packing_nothing_and_missing_ids(documents):
    assert packing.pack_documents(documents(), PATH).isEmpty()
    row = packing.pieces_of(packing.pack_documents(documents((None, "a", "s")), PATH)).first()
    assert (row.doc_id, row.start, row.length) == (None, 0, 2)


def test_little_is_left_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [r[0] for r in rows_of(packing.pack_documents(docs, PATH), "n_tokens")]
    assert sum(sizes) > 0.98 * 2048 * len(sizes)


def test_packing_does_not_shuffle(documents):
    plan = packing.pack_documents(documents("a"), PATH)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
