"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows

#: Kinds in the order in which spans of the same start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "url", "secret")
BASE = KINDS[:4]

# The boundaries of the base kinds.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "token", "AKIA")
SCHEMES = ("http://", "https://", "ftp://")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT_TAIL = re.compile(r"(?:[\x20]?(?:no\.?|number|nr\.?|num\.?))?[\x20]?[:=#]?[\x20]?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9](?:[\x20-]?[0-9]){5,19})")
SECRET_TAIL = re.compile(r"[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9+/_.-]{8,})")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")
USER_URL = re.compile(r"[^\s/@:\"<>]+:[^\s/@\"<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@cache
def automaton() -> ahocorasick.Automaton:
    """Cues with the kind of parser that they wake; words in lower, title and upper case."""
    found = ahocorasick.Automaton()
    for cue in ("@", "+", *"0123456789"):
        found.add_word(cue, ("digit" if cue.isdigit() else cue, len(cue)))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.title(), cue.upper()}:
                found.add_word(form, (kind, len(cue)))
    found.make_automaton()
    return found


class Spans:
    """One text's spans.  Every parser begins at a cue, never before the end of its kind's last match, so each kind is
    leftmost and without overlap, and a text is read a bounded number of times."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[int, int, str]] = []
        self.after = dict.fromkeys(KINDS, 0)

    def keep(self, kind: str, start: int, end: int) -> None:
        self.found.append((start, end, kind))

    def at_sign(self, at: int) -> None:
        start, least = at, self.after["email"]
        while start > least and self.text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(self.text, at + 1)):
            self.after["email"] = m.end()
            self.keep("email", start, m.end())
        elif start < at:
            self.after["email"] = at  # nothing left of this sign can be in a later address

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.after["ip"]:
            if m := IP.match(text, at):
                self.after["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    self.keep("ip", at, m.end())
            else:
                self.after["ip"] = DIGITS.match(text, at).end()
        if at >= self.after["card"]:
            if m := CARD.match(text, at):
                self.after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    self.keep("card", at, m.end())

    def plus(self, at: int) -> None:
        if at >= self.after["phone"] and (m := PHONE.match(self.text, at)):
            self.after["phone"] = m.end()
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                self.keep("phone", at, m.end())

    def account(self, end: int) -> None:
        if m := ACCOUNT_TAIL.match(self.text, end):
            start, body = m.start(1), m[1]
            kind = "iban" if body[0].isalpha() else "account"
            if start < self.after[kind]:
                return
            if kind == "account":
                self.after[kind] = m.end()
                self.keep(kind, start, m.end())
                return
            while len(body) > 14 and not iban_valid(body):  # the run may have taken the words after the number with it
                body = body[:-1].rstrip()
            if len(body) > 14:
                self.after[kind] = start + len(body)
                self.keep(kind, start, start + len(body))

    def scheme(self, start: int, end: int) -> None:
        """A locator is personal only where it carries a user and a password.  It is read as far as it goes: no part of it
        may hold the slashes of a scheme, so no character is read for two locators."""
        if start >= self.after["url"] and (m := USER_URL.match(self.text, end)):
            self.after["url"] = m.end()
            self.keep("url", start, m.end())

    def secret(self, start: int, end: int) -> None:
        if start < self.after["secret"]:
            return
        if m := KEY_ID.match(self.text, start):
            self.after["secret"] = m.end()
            self.keep("secret", start, m.end())
        elif m := SECRET_TAIL.match(self.text, end):
            self.after["secret"] = m.end()
            self.keep("secret", m.start(1), m.end(1))


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text in code points, by start and then in the order of ``KINDS``."""
    spans = Spans(text)
    for last, (cue, size) in automaton().iter(text):
        if cue == "digit":
            spans.digit(last)
        elif cue == "@":
            spans.at_sign(last)
        elif cue == "+":
            spans.plus(last)
        elif cue == "account":
            spans.account(last + 1)
        elif cue == "secret":
            spans.secret(last + 1 - size, last + 1)
        else:
            spans.scheme(last + 1 - size, last + 1)
    return sorted(spans.found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def personal_data(docs: DataFrame, find: Callable[[str], list[tuple[int, int, str]]] = find_spans) -> DataFrame:
    """Spans of personal data of every whole text: ``doc_id``, ``spans`` as an array of (kind, start, end).

    Null text counts as empty; every row of ``docs`` gives one row, repeated rows too; other columns are not read.
    Narrow: nothing is shuffled.
    """
    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            yield r["doc_id"], [{"kind": k, "start": s, "end": e} for s, e, k in find(r["text"] or "")]

    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows,
        "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with the same columns, each span of ``text`` replaced by its kind; of overlapping spans the first stays.

    Null and empty texts stay as they are, every row gives one row, columns may have any names."""
    kept = docs.columns

    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            text, out, at = r["text"], [], 0
            for s, e, k in find_spans(text or ""):
                if s >= at:
                    out += [text[at:s], mark.format(k)]
                    at = e
            yield tuple(r[c] if c != "text" or text is None else "".join(out) + text[at:] for c in kept)

    return map_rows(docs, rows, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts per base kind and of all spans, the digest of the base spans and all spans as text, of :func:`personal_data`'s rows."""
    def of(*kinds):
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    def text(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.size(spans).cast("long").alias("n_spans"), F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(spans).alias("spans"))
