"""Token ids of Arrow texts with a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# words a worker remembers; it starts afresh beyond
MAX_WORDS = 800_000
# bytes of text turned into words at once
SLICE = 8 << 20

# the same for a worker that shares its memory with what other steps left
FEW_WORDS = 300_000
SMALL_SLICE = 4 << 20

# letters whose composed form is themselves and whose small letter is the same wherever they stand
LETTERS = re.compile("[A-Za-z]+"), re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
PROBES = ("hello", "Zqxv", "THE", "x", "tionandly"), ("Zürich", "ÀÇĐŁž", "éç", "ǅȺ")
MARKS = string.punctuation.replace("'", "")
# how byte-level vocabularies write the bytes that are no printable characters
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}

_encoders: dict[tuple[str, bool], "TextEncoder"] = {}


def encoder(path: str, small: bool = False) -> "TextEncoder":
    """The worker's encoder for the tokenizer file at ``path``; a ``small`` one remembers fewer words."""
    if (path, small) not in _encoders:
        _encoders[path, small] = TextEncoder(path, *((FEW_WORDS, SMALL_SLICE) if small else ()))
    return _encoders[path, small]


class TextEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A tokenizer that drops white space never joins what stands on both sides of a space or a line end, so
    the ids of a text are those of its words in order. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS, slice_bytes: int = SLICE):
        self._max_words, self._slice = max_words, slice_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        whole = self._whole
        self.by_word = all(
            whole(f"{a}{gap}{b}") == whole(a) + whole(b)
            for gap in (" ", "\n", " \n  ") for a, b in (("a", "b"), ("It", "'s"), ("1", "2"), ("!", "!"), ("é", "́"), ("", "x"))
        )
        self._model = self._tokenizer.model
        self._forget()
        as_whole = [self.by_word and all(self._letters(w) == whole(w) for w in words) for words in PROBES]
        split = self.by_word and all(whole(f"ab{m}") == whole("ab") + whole(m) for m in (",", ".", "%%%", "-+", "#?~"))
        self._plain = LETTERS[as_whole == [True, True]] if as_whole[0] and split else None

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._ids = array("I")
        self._begin = array("q")
        self._size = array("i")

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        small = word.lower()
        if small in self._code and small != word:
            return self._known(small)
        if not small.isascii():
            small = small.encode().decode("latin-1").translate(BYTES)
        return [t.id for t in self._model.tokenize(small)]

    def _word(self, word: str) -> list[int]:
        if self._plain:
            # letters and the marks behind them are never one token
            head = word.rstrip(MARKS)
            if self._plain.fullmatch(head):
                return self._letters(word) if len(head) == len(word) else self._known(head) + self._known(word[len(head) :])
        return self._whole(word)

    def _known(self, word: str) -> list[int]:
        if word not in self._code:
            self._learn([word])
        code = self._code[word]
        begin = self._begin[code]
        return self._ids[begin : begin + self._size[code]].tolist()

    def _learn(self, words: list[str]) -> None:
        code, begin, size, ids = self._code, self._begin, self._size, self._ids
        for word in words:
            if word not in code:
                found = self._word(word) if word else []
                code[word] = len(begin)
                begin.append(len(ids))
                size.append(len(found))
                ids.extend(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts in a row, and the end of each text's ids. A null text has none."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_word:
            found = [self._whole(t) for t in texts.to_pylist()]
            ends = np.cumsum([len(f) for f in found], dtype=np.int64)
            return np.fromiter((i for f in found for i in f), np.uint32, int(ends[-1]) if len(ends) else 0), ends
        parts, ends, base = [], [], 0
        for piece in _slices(texts, self._slice):
            ids, end = self._encode_words(piece)
            parts.append(ids)
            ends.append(end + base)
            base += len(ids)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(ends)

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._code) > self._max_words:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        codes = np.fromiter(map(self._code.__getitem__, distinct), np.int64, len(distinct))
        known = np.frombuffer(self._ids, np.uint32) if len(self._ids) else np.zeros(0, np.uint32)
        begin, size = np.frombuffer(self._begin, np.int64), np.frombuffer(self._size, np.int32)
        codes = codes[words.indices.to_numpy()]
        sizes = size[codes].astype(np.int64)
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = known[np.arange(total) + np.repeat(begin[codes] - (after - sizes), sizes)]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ends = np.append(0, after)[offsets[1:] - offsets[0]]
        del known, begin, size
        return ids, ends


def _slices(texts: pa.Array, size: int):
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        limit = size + (sizes[at - 1] if at else 0)
        to = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
        yield texts.slice(at, to - at)
        at = to
