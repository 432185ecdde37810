"""Two tokenizers over the same bytes: ids of both, groups between common ends, links at common ends."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

#: White space as both kinds of tokenizer see it: Unicode's.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANKS = "".join(map(chr, BLANKS))
#: Blanks before which texts may be cut, as far as no piece of the vocabulary spans such a place.
CUTS = " \n\t"
SPACE = "▁"
#: Bits of an id of B in a pair's code; vocabularies have fewer entries than half of it.
ID_BITS = 24
#: Characters of a segment that the memo holds at most, segments that it holds before it begins anew.
MEMO_CHARS, MEMO_SEGMENTS = 64, 300_000
#: Characters of a text that are worked on at once.
SLICE_CHARS = 1 << 20


class Segment(NamedTuple):
    """What a segment adds to its text: counts of ids, its groups, its links as pair codes, its bytes where a side differs from it."""

    n_a: int
    n_b: int
    groups: str
    links: bytes
    joined: tuple[bytes, bytes] | None


def byte_decoder() -> dict[str, int]:
    """Character of a byte-level vocabulary -> its byte: printable Latin-1 stands for itself, the rest for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


def link_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer of 47 bits for an id pair."""
    return (a.astype(np.int64) << ID_BITS) | b.astype(np.int64)


def group_texts(ids_a: list[int], ids_b: list[int], at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
    """``a1,a2|b1`` for every group; ``at_a`` and ``at_b`` are the places of the ids that end one."""
    text_a, text_b = [*map(str, ids_a)], [*map(str, ids_b)]
    groups, i, j = [], 0, 0
    for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
        groups.append(f"{text_a[i] if x == i + 1 else ','.join(text_a[i:x])}|{text_b[j] if y == j + 1 else ','.join(text_b[j:y])}")
        i, j = x, y
    return groups


class Aligner:
    """Segments of texts under a byte-level tokenizer (A, over space + text) and a sentence-piece tokenizer (B, which adds the space).

    Neither has a token that spans a place between a character that is no blank and a cut blank, so the parts between such
    places are tokenized on their own, once for each distinct part while the memo lasts.  Both tokenizers end a token there,
    so groups and links of a text are those of its parts.  If B's vocabulary has a piece across a kind of blank, texts are not cut there.
    """

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = byte_decoder()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        entries = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(entries)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        if max(len(self.size_a), len(self.size_b)) > 1 << ID_BITS - 1:
            raise ValueError("vocabulary is too large for pair codes")
        texts = [p.replace(SPACE, " ") for k, p in enumerate(entries) if not self.b.is_byte(k)]
        cuts = "".join(c for c in CUTS if not any(re.search(f"[^{BLANKS}]{c}", p) for p in texts))
        #: The mark that stands before a part, so that B's added space is not the part's; it must be one piece.
        self.marked = len(self.b.encode("x")) == 1 and " " in cuts
        kept = "".join(c for c in BLANKS if c not in cuts)
        self.part = re.compile(f"[{BLANKS}]+[^{BLANKS}]*(?:[{kept}][{BLANKS}]*[^{BLANKS}]*)*")
        self.cuts = cuts
        self.memo: dict[str, Segment] = {}

    def parts(self, text: str) -> Iterator[list[str]]:
        """Parts of space + ``text``, about ``SLICE_CHARS`` characters at a time."""
        if not self.marked:
            yield [" " + text]
            return
        text, at = " " + text, 0
        while len(text) - at > SLICE_CHARS:
            found = [m.start() for m in self.part.finditer(text, at, at + SLICE_CHARS)]
            if len(found) < 2:  # a part that is longer than a slice
                found = [at, self.part.match(text, at).end()]
            yield self.part.findall(text, at, found[-1])
            at = found[-1]
        if at < len(text):
            yield self.part.findall(text, at)

    def segments(self, parts: list[str]) -> list[Segment]:
        """The segment of every part."""
        memo = self.memo
        missing = [p for p in set(parts) if p not in memo]
        if not missing:
            return [memo[p] for p in parts]
        if len(memo) + len(missing) > MEMO_SEGMENTS:
            memo.clear()
            missing = list(set(parts))
        mine: dict[str, Segment] = {}
        for at in range(0, len(missing), 4000):
            some = missing[at:at + 4000]
            joint = [p for p in some if self.marked and SPACE not in p and p[-1] not in BLANKS]
            if joint:
                self._learn_joint(joint, mine)
            self._learn_each([p for p in some if p not in mine], mine)
        found = [mine.get(p) or memo[p] for p in parts]
        memo.update((p, s) for p, s in mine.items() if len(p) <= MEMO_CHARS)
        return found

    def _learn_joint(self, parts: list[str], out: dict[str, Segment]) -> None:
        """Segments of ``parts``, tokenized as one text, which they may be: each begins with a cut blank and ends with none.

        Where the two sides' bytes are not those of the text, nothing is learned.
        """
        whole = "".join(parts)
        ids_a = self.a.encode(whole, add_special_tokens=False).ids
        ids_b = self.b.encode("x" + whole, num_threads=1)[1:]
        own = whole.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != own or b"".join(map(self.bytes_b.__getitem__, ids_b)) != own:
            return
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends, at_a, at_b = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), True, True)
        codes = link_code(a[at_a], b[at_b])
        groups = group_texts(ids_a, ids_b, at_a, at_b)
        sizes = np.array([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        last = np.searchsorted(ends, np.cumsum(sizes))  # each part ends with a group
        data = codes.tobytes()
        g = i = j = 0
        for part, k in zip(parts, last.tolist()):
            x, y = int(at_a[k]) + 1, int(at_b[k]) + 1
            out[part] = Segment(x - i, y - j, ";".join(groups[g:k + 1]), data[8 * g:8 * k + 8], None)
            g, i, j = k + 1, x, y

    def _learn_each(self, parts: list[str], out: dict[str, Segment]) -> None:
        a = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        b = [ids[1:] for ids in self.b.encode(["x" + p for p in parts], num_threads=1)] if self.marked else self.b.encode([p[1:] for p in parts], num_threads=1)
        for part, ids_a, ids_b in zip(parts, a, b):
            out[part] = self._segment(part, ids_a, ids_b)

    def _segment(self, part: str, ids_a: list[int], ids_b: list[int]) -> Segment:
        joined = b"".join(map(self.bytes_a.__getitem__, ids_a)), b"".join(map(self.bytes_b.__getitem__, ids_b))
        own = part.encode("utf-8", "surrogatepass")
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        _, at_a, at_b = np.intersect1d(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), True, True)
        codes, groups = link_code(a[at_a], b[at_b]), group_texts(ids_a, ids_b, at_a, at_b)
        return Segment(len(a), len(b), ";".join(groups), codes.tobytes(), None if joined == (own, own) else joined)

    def forget(self) -> None:
        """Give the memo's memory back."""
        self.memo = {}


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each process."""
    return Aligner(byte_level, pieces)
