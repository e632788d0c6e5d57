"""Byte-level BPE ids of whole texts, through the `tokenizers` library."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters, digits and white space below U+0250. This kind of tokenizer cuts a text
# into words that are encoded apart from each other. Words are the same in every
# text, so the ids of each are asked of the library once.
_LIMIT = 0x250
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(_LIMIT, _OTHER, np.uint8)
for _kind, _chars in ((_LETTER, "A-Za-zªµºÀ-ÖØ-öø-ɏ"), (_DIGIT, "0-9²³¹¼½¾"),
                      (_BLANK, " \t\n\r\x0b\x0c\x85\xa0")):
    _KIND[[c for c in range(_LIMIT) if re.match(f"[{_chars}]", chr(c))]] = _kind
_SPACE, _QUOTE = ord(" "), ord("'")
_GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")  # a word begins here, whatever lies around

CACHED_WORDS = 400_000
CACHED_LENGTH = 64
AT_ONCE = 2 << 20  # bytes of texts cut into words together
ASKED_AT_ONCE = 100  # words


def _word_starts(code: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Which characters begin a word, for the characters of documents in a row.

    The usual rule: 's 't 're 've 'm 'll 'd, else letters, digits or others in a row,
    with a space before them, else blanks in a row, the last before a word apart.
    """
    n = len(code)
    kind = _KIND[code]
    first = np.zeros(n + 3, bool)
    first[doc_starts] = first[n:] = True
    blank = kind == _BLANK
    before_word = np.zeros(n, bool)  # a blank, and no blank comes next in its document
    before_word[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    starts = before_word.copy()
    starts[1:] |= (kind[1:] != kind[:-1]) & ~(before_word & (code == _SPACE))[:-1]
    starts |= first[:n]

    quote = np.flatnonzero((code == _QUOTE) & starts)
    quote = quote[~first[quote + 1]]
    one, two = code[quote + 1], np.append(code, 0)[quote + 2].astype(np.int32)
    two[first[quote + 2]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.isin(one.astype(np.int32) << 16 | two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])
    starts[quote[short | long] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long] + 3))
    starts[after[after < n]] = True
    return starts


def _pieces(text: str) -> list[str]:
    """A long text, cut where words begin."""
    cuts = [0]
    while gap := _GAP.search(text, cuts[-1] + AT_ONCE):
        cuts.append(gap.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class ByteBpe:
    """Ids of texts as numpy arrays, equal to the library's for each whole text.

    A text with a special token's string, or with characters from U+0250 on (whose
    classes differ between Unicode versions), goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([rf"[^\x00-\x{{{_LIMIT - 1:x}}}]", *map(re.escape, specials)])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # The same tokenizer, for what is cut into words already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        if not self._cuts_words_as_here():
            raise ValueError(f"{path} is not a byte-level BPE that cuts words by the usual rule")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _cuts_words_as_here(self) -> bool:
        probe = "It's  a\ttest,\r\n of 12½ wörds' (don't)\xa0 x_y  "
        return self._library(probe).tolist() == self.encode(probe).tolist()

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word; the library is asked for words not seen yet."""
        ids = list(map(self.words.get, words))
        new = [i for i, found in enumerate(ids) if found is None]
        for k in range(0, len(new), ASKED_AT_ONCE):
            asked = new[k:k + ASKED_AT_ONCE]
            answers = self.of_words.encode_batch_fast(
                [words[i] for i in asked], add_special_tokens=False)
            for i, answer in zip(asked, answers):
                ids[i] = np.array(answer.ids, self.dtype).tobytes()
                if len(self.words) < CACHED_WORDS and len(words[i]) <= CACHED_LENGTH:
                    self.words[words[i]] = ids[i]
        return ids

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a NULL text is an empty one. So many texts are taken
        together as have `AT_ONCE` bytes; one that has more goes in pieces."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            begun = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begun + AT_ONCE, "right")))
            some = texts.slice(at, to - at).cast(pa.string())
            whole = pc.match_substring_regex(some, self.whole)
            cut = pc.if_else(whole, "", some) if pc.any(whole).as_py() else some
            if ends[to - 1] - begun > AT_ONCE:
                cut = pa.array(_pieces(cut[0].as_py()), pa.string())
                parts = [ids for k in range(len(cut)) for ids in self._encode_cut(cut.slice(k, 1))]
                encoded = iter([np.concatenate(parts)])
            else:
                encoded = self._encode_cut(cut)
            for i, (as_whole, ids) in enumerate(zip(whole.to_pylist(), encoded)):
                yield self._library(some[i].as_py()) if as_whole else ids
            at = to

    def _encode_cut(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """Each word that these texts have is looked up once, and its ids are put
        wherever it stands."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]

        at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # where characters begin
        code = data[at].astype(np.uint16)
        wide = np.flatnonzero(code >= 0x80)
        code[wide] = (code[wide] & 0x1F) << 6 | (data[at[wide] + 1] & 0x3F)
        starts = _word_starts(code, np.searchsorted(at, offsets))
        cuts = np.append(at[starts], np.int32(len(data)))

        found = pa.StringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        ids = self._ids_of_words(found.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        table = np.frombuffer(b"".join(ids), self.dtype)

        word = found.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[word]))
        shift = (np.cumsum(size) - size)[word] - ends[:-1]
        ids = table[np.arange(ends[-1]) + np.repeat(shift, size[word])]
        bounds = ends[np.searchsorted(cuts, offsets)].tolist()
        for begin, end in zip(bounds, bounds[1:]):
            yield ids[begin:end]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)
