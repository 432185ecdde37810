"""Column expressions over text.  Every function takes and returns a Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework import constants as K

#: Every character Python and Unicode call white space, spelled out so Java and RE2 agree on it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim white space of every kind (SQL ``trim`` knows blanks only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def lstrip(c) -> Column:
    return F.ltrim(col(c), F.lit(WHITESPACE))


def strip_long(c) -> Column:
    """:func:`strip` for texts of many lines: a trim notes the place of every character, so clean ends are looked at first."""
    return _bound(c, lambda x: F.when(reduce(
        lambda a, b: a | b, [F.startswith(x, F.lit(w)) | F.endswith(x, F.lit(w)) for w in WHITESPACE]), strip(x)).otherwise(x))


#: White space that stands within a line.
IN_LINE = WS.replace(r"\t-\r", r"\t\x0b-\r")

# Single characters of the first 256 make one bit set in a Java class, so this pattern costs one lookup a character.
_COMMON = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
_RARE = [ch for ch in WHITESPACE if ord(ch) > 127]


def _any(probes, x: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in probes])


def _is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def _bound(c, *rewrites) -> Column:
    """Apply rewrites in order; a one-element array binds each step's text, so it is worked out once however often the
    step mentions it."""
    held = F.array(col(c))
    for rewrite in rewrites:
        held = F.transform(held, rewrite)
    return F.element_at(held, 1)


def _where(probes, rewrite):
    """A rewrite for texts containing one of the probes.  Probes are native byte scans: clean text passes at that
    price and runs no regular expression."""
    return lambda x: F.when(_any(probes, x), rewrite(x)).otherwise(x)


def _collapse(x: Column) -> Column:
    # Single blanks stay as they are, which spares most replacements.
    plain = F.regexp_replace(x, f"[ {_COMMON}]{{2,}}|[{_COMMON}]", " ")
    return F.when(_is_ascii(x), plain).when(~_any(_RARE, x), plain).otherwise(F.regexp_replace(x, WS + "+", " "))


def squeeze(c) -> Column:
    """Collapse every run of white space to one blank and strip."""
    return F.btrim(_bound(c, _collapse))


normalize_for_match = squeeze


def clean_extracted_text(c) -> Column:
    """Line ends, ligatures, end-of-line hyphens, trailing and repeated blanks, blank lines, strip."""
    return strip(_bound(
        c,
        _where(("\r",), lambda x: F.regexp_replace(x, "\r\n?", "\n")),
        _where(("ﬁ", "ﬂ"), lambda x: F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))),
        _where(("-\n",), lambda x: F.regexp_replace(x, "-\n(?=[a-z])", "")),
        lambda x: F.when(_any((" \n", "\t"), x), F.regexp_replace(x, "(?md)[ \t]+$", "")).otherwise(F.rtrim(x)),
        _BLANKS, _BLANK_LINES))


_BLANKS = _where(("  ", "\t"), lambda x: F.regexp_replace(x, "[ \t]{2,}", " "))
_BLANK_LINES = _where(("\n\n\n",), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n"))
_DOT_LEADERS = _where(("....",), lambda x: F.regexp_replace(x, r"\.{4,}", " "))


def two_newlines(c) -> Column:
    """Three and more newlines become two."""
    return _bound(c, _BLANK_LINES)


def remove_dot_leaders(c) -> Column:
    return _bound(c, _DOT_LEADERS)


def light_clean(c) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return strip_long(_bound(text, _where(("\xa0",), lambda x: F.translate(x, "\xa0", " ")), _DOT_LEADERS, _BLANKS, _BLANK_LINES))


_FOLD_FROM = K.DASHES + K.SINGLE_QUOTES + K.DOUBLE_QUOTES + K.SPACES
_FOLD_TO = "-" * len(K.DASHES) + "'" * len(K.SINGLE_QUOTES) + '"' * len(K.DOUBLE_QUOTES) + " " * len(K.SPACES)


def fold_punctuation(c) -> Column:
    """ASCII forms of look-alike dashes, quotes and blanks, then :func:`squeeze`."""
    marks = K.DASHES + K.SINGLE_QUOTES + K.DOUBLE_QUOTES + K.SPACES
    return F.btrim(_bound(
        c,
        lambda x: F.when(_is_ascii(x), x).when(~_any(marks, x), x).otherwise(F.translate(x, _FOLD_FROM, _FOLD_TO)),
        _collapse))


def normalize_message(c) -> Column:
    return F.lower(strip(F.regexp_replace(col(c), r"(?U)[^\w\s]", "")))


def tokenize(c) -> Column:
    """Lower-case alphanumeric ASCII runs in order, repeats kept."""
    return F.array_remove(F.split(F.lower(col(c)), "[^a-z0-9]+"), "")


def long_words(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), F.lower)


def content_words(c) -> Column:
    return F.array_except(F.array_distinct(long_words(c)), F.array(*[F.lit(w) for w in K.STOP_WORDS]))


def word_count(c) -> Column:
    """Number of white-space separated words."""
    t = squeeze(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def slugify(c) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("clinic")).otherwise(s)


def safe_url(c) -> Column:
    return F.when(F.lower(col(c)).rlike("^https?://"), col(c))


def source_label(title, page) -> Column:
    label = F.coalesce(F.nullif(col(title), F.lit("")), F.lit(K.DEFAULT_LABEL))
    p = col(page)
    return F.when(p.isNotNull() & (p != 0), F.concat(label, F.lit(" (p. "), p.cast("string"), F.lit(")"))).otherwise(
        label
    )


# --- line shapes --------------------------------------------------------------------------------------
def is_protected(line) -> Column:
    return col(line).rlike(K.PROTECTED_LINE)


def is_page_number(line) -> Column:
    return col(line).rlike(K.PAGE_NUMBER_LINE) & ~is_protected(line)


def line_shape(line) -> Column:
    return (
        F.when(is_protected(line), "protected").when(is_page_number(line), "page_number").otherwise("text")
    )


def furniture_key(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z]+", "")


def _hits(low: Column, phrases) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def _maybe(low: Column, phrases) -> Column:
    """False where none of the phrases stands in the text, found in one walk: any first three letters, then the rest of any phrase."""
    heads = "".join("[" + "".join(sorted({p[k] for p in phrases})) + "]" for k in range(3))
    return low.rlike(heads + "(?:" + "|".join(rf"\Q{p[3:]}\E" for p in phrases) + ")")


def phrase_hits(c, phrases) -> Column:
    """How many of the phrases stand in the text, which is lowered once."""
    return _bound(F.lower(col(c)), lambda low: _hits(low, phrases))


def is_copyright_page(c) -> Column:
    return phrase_hits(c, K.COPYRIGHT_PHRASES) >= 2


def toc_line_ratio(c) -> Column:
    def ratio(lines):
        n = F.size(lines)
        # The pattern ends on the stripped line's end and is four characters long at most.
        entries = F.size(F.filter(lines, lambda x: F.substring(x, -4, 4).rlike(K.TOC_LINE)))
        return F.when(n < K.TOC_MIN_LINES, F.lit(0.0)).otherwise(entries / n)

    def whole(x):
        return _bound(F.array_remove(F.transform(F.split(x, "\n"), strip), ""), ratio)

    # A text in which no line ends in a digit is not cut into lines.
    return _bound(c, lambda x: F.when(~x.rlike(f"(?md)[0-9]{IN_LINE}*$"), F.lit(0.0)).otherwise(whole(x)))


def is_toc_page(c) -> Column:
    return (phrase_hits(c, K.TOC_WORDS) >= 2) | (toc_line_ratio(c) >= K.TOC_LINE_RATIO)


def page_type(c) -> Column:
    # In most texts none of the phrases stands, and they are not searched phrase by phrase.
    toc = F.when(toc_line_ratio(c) >= K.TOC_LINE_RATIO, "table_of_contents").otherwise("content")
    return _bound(F.lower(col(c)), lambda low: (
        F.when(~_maybe(low, K.COPYRIGHT_PHRASES + K.TOC_WORDS), toc)
        .when(_hits(low, K.COPYRIGHT_PHRASES) >= 2, "copyright")
        .when(_hits(low, K.TOC_WORDS) >= 2, "table_of_contents")
        .otherwise(toc)))


# --- headings -----------------------------------------------------------------------------------------
def is_numbered_heading(line) -> Column:
    return col(line).rlike(K.NUMBERED_HEADING)


def is_annex_heading(line) -> Column:
    return col(line).rlike(K.ANNEX_HEADING)


def is_plain_heading(line) -> Column:
    return col(line).rlike(K.PLAIN_HEADING)


def is_boilerplate_heading(heading) -> Column:
    """Furniture that only looks like a heading; a wrapped heading is tried joined and line by line."""
    h = strip(heading)
    return F.translate(h, "\n", " ").rlike(K.HEADING_BOILERPLATE) | F.exists(
        F.split(h, "\n"), lambda x: strip(x).rlike(K.HEADING_BOILERPLATE)
    )


def looks_titled(line) -> Column:
    """All letters upper case, or at least two plain words of which 60 % are capitalised."""
    h = col(line)
    words = F.filter(F.split(strip(h), WS + "+"), lambda w: w.rlike(r"^\p{L}+$"))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    letters = F.regexp_replace(h, r"\P{L}", "")
    all_upper = letters.rlike(r"^\p{Lu}+$")
    return all_upper | ((F.size(words) >= 2) & (capital >= 0.6 * F.size(words)))


# --- splitting ----------------------------------------------------------------------------------------
def sentences(c) -> Column:
    """Pieces between a full stop, question or exclamation mark and the white space after it."""
    return F.split(strip(c), r"(?<=[.!?])" + WS + "+")


def quote_head(c, limit: int = K.QUOTE_MAX) -> Column:
    """Squeezed text cut at ``limit`` characters on a word boundary."""
    t = squeeze(c)
    return F.when(F.length(t) > limit, F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")).otherwise(t)


# --- message labels -----------------------------------------------------------------------------------
def greeting_type(c) -> Column:
    n = normalize_message(c)
    out = None
    for kind, phrases in K.GREETINGS.items():
        hit = n.isin(*phrases)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def classify_intent(c) -> Column:
    t = col(c)
    return (
        F.when(greeting_type(t).isNotNull(), "greeting")
        .when(t.rlike(K.RESCHEDULE), "reschedule")
        .when(t.rlike(K.CANCEL), "cancel")
        .when(t.rlike(K.BOOK), "book")
        .when(t.rlike(K.AVAILABILITY), "availability")
        .when(t.rlike(K.APPOINTMENT), "appointment")
        .otherwise("medical")
    )


def personal_request(c) -> Column:
    t = squeeze(c)
    return F.when(t.rlike(K.PERSONAL_DIAGNOSIS), K.PERSONAL_REASONS[0]).when(
        t.rlike(K.PERSONAL_DOSAGE), K.PERSONAL_REASONS[1]
    )


def clearly_off_topic(c) -> Column:
    return col(c).rlike(K.OFF_TOPIC)
