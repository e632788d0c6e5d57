"""Exact token counts of every prefix, by dynamic programming over a BPE vocabulary."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from portolan.llm.common import chunked, map_arrow

CACHED_CHARS = 10_000_000  # of words whose counts a worker keeps
CACHED_PAIRS = 400_000
GROUP_CHARS = 4_000_000  # of texts whose new words are worked out together
_SPACE = "▁"  # fixed value: how the vocabulary writes a blank
_MARKS = ".,;:!?\")"  # a word of letters is counted apart from these where no token holds both


class PrefixCounter:
    """Counts for a BPE model of the `sentencepiece` library with byte fallback.

    A sequence of tokens is the encoding of its text if each two neighbours are the
    encoding of theirs. So exactly one vocabulary token can end the encoding of a
    prefix: one that fits the last token of the prefix before it, and

        count(prefix) = count(prefix without that token) + 1.

    A character outside the vocabulary counts its bytes and fits anything. No token
    goes on from a word into the blank after it or over a line end (checked), so words
    are counted apart and summed; a word's counts are kept, as words come again. New
    words are taken in order, each from the prefix that it shares with the one before.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i).replace(_SPACE, " "): model.get_score(i) for i in ids}
        self._longest = max(map(len, self.score))
        if any("\n" in p or " " in p.lstrip(" ") for p in self.score):
            raise ValueError(f"{path} has tokens that reach over words or lines")
        marks = "".join(m for m in _MARKS if not any(
            re.search(rf"[^\W\d_]{re.escape(m)}", p) for p in self.score))
        self._segments = re.compile(
            rf" *[^\W\d_]+(?=[ \n{re.escape(marks)}]|\Z)| *[^ \n]+| +|\n")
        self._built: dict[str, list | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._word_steps: dict[str, bytes] = {}
        self._kept_chars = 0
        for probe in ("It's  ﬁne,\t①\n\n Größe 12½ ", "日本 x​🙂<s>"):
            if self.counts(probe)[1:].tolist() != [
                    len(model.encode(probe[:n])) for n in range(1, len(probe) + 1)]:
                raise ValueError(f"{path} is not a plain BPE model with byte fallback")

    def _building(self, token: str) -> list[tuple[float, str, str]] | None:
        """How BPE builds a token, the best-scored neighbours first: before each merge its
        score and the pieces at both ends. None if the token is not what comes out."""
        if token not in self._built:
            parts, states = list(token), []
            while True:
                best = max(
                    ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in self.score), default=None)
                states.append((best[0] if best else -math.inf, parts[0], parts[-1]))
                if best is None:
                    break
                i = -best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self._built[token] = states if len(parts) == 1 else None
        return self._built[token]

    def _pair_fits(self, first: str, second: str) -> bool:
        """Whether two tokens are the encoding of their text: both are built, and at no
        time are the pieces that meet the best neighbours to merge (the leftmost of equals)."""
        left, right = self._building(first) if first else None, self._building(second)
        if right is None or not first:
            return right is not None
        i = j = 0
        while True:
            (mine, _, end), (yours, start, _) = left[i], right[j]
            across = self.score.get(end + start, -math.inf)
            if across > mine and across >= yours:
                return False
            if mine >= yours:
                if mine == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _learn(self, words: set[str]) -> None:
        """Keep by how much each character of each word changes the count."""
        score, fits, longest = self.score, self._fits, self._longest
        if len(fits) > CACHED_PAIRS:
            fits.clear()
        counts, last, steps, before = [0], [""], bytearray(), ""
        for word in sorted(words):
            shared = 0
            for mine, other in zip(word, before):
                if mine != other:
                    break
                shared += 1
            del counts[shared + 1:], last[shared + 1:], steps[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    if token in score:
                        pair = last[start], token
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self._pair_fits(*pair)
                        if fit:
                            count = counts[start] + 1
                            break
                else:
                    count, token = counts[-1] + len(word[end - 1].encode()), ""
                steps.append(count - counts[-1] & 255)
                counts.append(count)
                last.append(token)
            before = word
            self._word_steps[word] = bytes(steps)
            self._kept_chars += len(word)

    def words(self, text: str) -> list[str]:
        """The words of a text as the model sees them: with a blank before the first."""
        return self._segments.findall(" " + text.replace(_SPACE, " ")) if text else []

    def steps(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The token counts of all prefixes of each text, a signed byte per character: their
        running sum. A token is far shorter than a byte can count."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group_steps(held)
                held, chars = [], 0
        yield from self._group_steps(held)

    def _group_steps(self, texts: list[str]) -> Iterator[bytes]:
        if self._kept_chars > CACHED_CHARS:
            self._word_steps.clear()
            self._kept_chars = 0
        split = list(map(self.words, texts))
        self._learn(set().union(*split).difference(self._word_steps))
        for words in split:
            joined = b"".join(map(self._word_steps.__getitem__, words))
            # The model's own blank is no prefix of the text: its step goes with the next.
            first = np.frombuffer(joined[:2], np.int8).sum(dtype=np.int8)
            yield first.tobytes() + joined[2:] if joined else joined

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix of a text; place n is the prefix of n characters."""
        return prefix_counts_of(*self.steps([text]))


def prefix_counts_of(steps: bytes) -> np.ndarray:
    """Place n: the tokens of the first n characters."""
    found = np.zeros(len(steps) + 1, np.int32)
    np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32, out=found[1:])
    return found


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One per worker process and file."""
    return PrefixCounter(path)


def store_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, steps): the token counts of all prefixes of each text, as the
    running sums of `steps`, a signed byte per character. What a text of any length up to
    any place has in tokens is answered from these (`answers`), without encoding again.

    Counts are the library's for the prefix alone, without begin, end or special tokens.
    Reads `doc_id` and `text`; other columns are not touched. Narrow: one pass, no
    shuffle. A NULL text is an empty one with no tokens; repeated rows are counted each;
    an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("steps", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = pc.fill_null(batch["text"], "")
                yield from zip(batch["doc_id"].to_pylist(), pc.binary_length(texts).to_pylist(),
                               counter.steps(t.as_py() for t in texts))

        yield from chunked(rows(), schema, 500)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), count,
                     "doc_id bigint, n_bytes bigint, steps binary")


def answers(stored: DataFrame, budgets: tuple[int, ...] = (), keep_counts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), per budget `chars_within_<budget>`, the characters of
    the longest prefix within it, and with `keep_counts` `prefix_counts`: array, place n
    the tokens of the first n characters. From the counts of `store_counts` alone."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
              *[(f"chars_within_{b}", pa.int64()) for b in budgets]]
    ddl = ", ".join(f"{name} bigint" for name, _ in fields)
    if keep_counts:
        fields.append(("prefix_counts", pa.list_(pa.int32())))
        ddl += ", prefix_counts array<int>"
    schema = pa.schema(fields)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n_bytes, steps in zip(
                        batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["steps"]):
                    counts = prefix_counts_of(steps.as_buffer())
                    n = int(counts[-1])
                    row = (doc_id, n_bytes, n, *[
                        len(counts) - 1 if n <= b else int(np.flatnonzero(counts <= b)[-1])
                        for b in budgets])
                    yield (*row, counts) if keep_counts else row

        yield from chunked(rows(), schema, 200 if keep_counts else 10_000)

    return map_arrow(stored.select("doc_id", "n_bytes", "steps"), answer, ddl)


def count_tokens(docs: DataFrame, model: str, budgets: tuple[int, ...] = (),
                 keep_counts: bool = False) -> DataFrame:
    """`answers` from the counts of `store_counts`."""
    return answers(store_counts(docs, model), budgets, keep_counts)


def tokens_of_prefix(counted: DataFrame, chars: int) -> DataFrame:
    """(doc_id, tokens) of the first `chars` characters, from the stored counts."""
    last = F.least(F.lit(chars), F.size("prefix_counts") - 1)
    return counted.select("doc_id", F.get("prefix_counts", last).cast("bigint").alias("tokens"))


def prefix_within(counted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars): the longest prefix of at most `budget` tokens, from the stored counts."""
    fits = F.transform("prefix_counts", lambda n, i: F.when(n <= budget, i).otherwise(0))
    return counted.select("doc_id", F.array_max(fits).cast("bigint").alias("chars"))
