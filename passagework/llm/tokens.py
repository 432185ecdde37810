"""Token ids of whole texts by a public tokenizer, word by word through a cache."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Words that a task remembers; beyond it the cache begins anew.
CACHE_WORDS = 500_000
#: Characters that are split into words at once.
SLICE_CHARS = 1 << 20
#: Python splits at these, the tokenizers' white space does not hold them.
#: Marks that may follow a word; together they are a token group of their own.
MARKS = ".,;:!?*&$%#|"
ODD_SPACES = re.compile("[\x1c-\x1f]")
ASCII_SPACE = re.compile("[ \t\n\v\f\r]+")


class WordEncoder:
    """Ids of a tokenizer that drops white space, so that a text's ids are its words' ids one after the other.

    Words are looked up in a cache; new ones are encoded together.  A word of letters and marks behind it
    shares the ids of the word and of the marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = np.array(e.ids, "<u4").tobytes()

    def _encode_letters(self, words: list[str]) -> None:
        """Words of letters only: each ends with the one token that carries the word's end, so many are encoded as one text."""
        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some) or ends[-1:] != len(ids):
                self._encode(some)
                continue
            data = ids.tobytes()
            for word, start, end in zip(some, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist()):
                self.known[word] = data[start:end]

    def _learn(self, words: set[str]) -> None:
        letters, stems, others = set(), {}, []
        for word in words:
            if word.isalpha() and plain_letters(word):
                letters.add(word)
            elif (stem := word.rstrip(MARKS)) != word and stem.isalpha() and plain_letters(stem):
                stems[word] = stem
            else:
                others.append(word)
        tails = {word[len(stem):] for word, stem in stems.items()}
        self._encode_letters([w for w in letters.union(stems.values()) if w not in self.known])
        self._encode([w for w in {*others, *tails} if w not in self.known])
        for word, stem in stems.items():
            self.known[word] = self.known[stem] + self.known[word[len(stem):]]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.  The words of all texts are looked up together."""
        whole: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def look_up() -> None:
            missing = set().union(*(words for _, words in held)) - self.known.keys()
            if len(self.known) + 2 * len(missing) > CACHE_WORDS:
                self.known, missing = {}, set().union(*(words for _, words in held))
            self._learn(missing)
            for k, words in held:
                whole[k].append(b"".join(map(self.known.__getitem__, words)))

        for k, text in enumerate(texts):
            for piece in slices(simple_lower(text)):
                if ODD_SPACES.search(piece):
                    held.append((k, [w for w in ASCII_SPACE.split(piece) if w]))
                else:
                    held.append((k, piece.split()))
                size += len(piece)
                if size >= SLICE_CHARS:
                    look_up()
                    held, size = [], 0
        look_up()
        return [b"".join(parts) for parts in whole]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Give the cache's memory back: a worker lives on for stages that encode nothing."""
        self.known = {}


def is_latin(text: str) -> bool:
    """Whether every character is of Latin-1, where lower case is one character for one and normal form changes nothing."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def simple_lower(text: str) -> str:
    """``text`` in lower case, as the tokenizer would make it, where that is simple; elsewhere ``text``.

    Marks of special ids are looked for before the tokenizer lowers, so a text that may hold one stays as it is.
    """
    return text.lower() if "<|" not in text and is_latin(text) else text


def plain_letters(word: str) -> bool:
    """Whether normal form and lower case leave a word of letters as letters, so that marks behind it are tokens of their own."""
    return word.isascii() or is_latin(word) or unicodedata.normalize("NFC", word).lower().isalpha()


def slices(text: str) -> Iterator[str]:
    """``text`` in slices that end at a blank; a longer run without blanks stays whole."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = text.rfind(" ", at, at + SLICE_CHARS)
        end = end if end > at else text.find(" ", at + SLICE_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each process."""
    return WordEncoder(path)
