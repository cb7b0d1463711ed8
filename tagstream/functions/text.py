"""Text functions: HTML to text (F1), lower case (F2), word tokens (F3), stop words (F4),
and the combined question text (P1, P2).  Porter stemming (F5) is in ``porter.py``."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The small English stop-word set of the analyzer the reference uses (33 words).
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
)

# Token rule: maximal runs of letters and digits (Unicode classes).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# HTML stripping steps, applied in this order.
HTML_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
HTML_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
HTML_COMMENTS = r"(?s)<!--.*?-->"
HTML_TAGS = r"<[^>]*>"
WHITESPACE = r"\s+"
# A character reference: a decimal or hexadecimal number, or a name, and its semicolon.
REFERENCE = r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);"
#: Named references are looked up in so many buckets, by crc32 of the name.
ENTITY_BUCKETS = 512


@lru_cache(maxsize=1)
def entity_table() -> dict[str, str]:
    """Name → characters of every HTML5 named reference, from the standard library.  A no-break space is a
    plain one here, as it separates words."""
    return {n[:-1]: " " if v == "\u00a0" else v for n, v in sorted(html5.items()) if n.endswith(";")}


@lru_cache(maxsize=1)
def _entity_buckets() -> Column:
    held: list[list] = [[] for _ in range(ENTITY_BUCKETS)]
    for name, chars in entity_table().items():
        held[zlib.crc32(name.encode()) % ENTITY_BUCKETS].append((name, chars))
    return F.from_json(F.lit(json.dumps([[{"n": n, "c": c} for n, c in b] for b in held])), "array<array<struct<n: string, c: string>>>")


def _numbered(ref: Column) -> Column:
    """The character of ``#233`` or ``#xE9``; numbers that are no character give U+FFFD, 160 a space."""
    n = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).cast("long")
    no_char = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(no_char, F.lit("\ufffd")).when(n == 160, F.lit(" ")).otherwise(char)


def _named(ref: Column) -> Column:
    bucket = F.get(_entity_buckets(), (F.crc32(ref.cast("binary")) % ENTITY_BUCKETS).cast("int"))
    return F.get(F.filter(bucket, lambda e: e["n"] == ref), F.lit(0))["c"]


def decode_entities(c) -> Column:
    """Character references decoded in one pass over the text cut at &; what is none stays as it is."""
    x = _c(c)

    def piece(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, REFERENCE, 1)
        char = F.when(ref.startswith("#"), _numbered(ref)).otherwise(_named(ref))
        known = F.when(ref != "", char)
        return F.when(i == 0, p).when(known.isNotNull(), F.concat(known, F.substring(p, F.length(ref) + 2, F.length(p)))).otherwise(F.concat(F.lit("&"), p))

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "&", -1), piece), "")).otherwise(x)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_text(c, decode: bool = True) -> Column:
    """visible text of HTML: script/style blocks and comments dropped, tags → one space,
    white space collapsed and trimmed, character references decoded."""
    x = _c(c)
    x = F.regexp_replace(x, HTML_SCRIPT, " ")
    x = F.regexp_replace(x, HTML_STYLE, " ")
    x = F.regexp_replace(x, HTML_COMMENTS, " ")
    x = F.regexp_replace(x, HTML_TAGS, " ")
    if decode:
        x = decode_entities(x)
    x = F.trim(F.regexp_replace(x, WHITESPACE, " "))
    return x


def lower_text(c) -> Column:
    """F2."""
    return F.lower(_c(c))


def tokens(c) -> Column:
    """lower-cased word tokens, empty strings dropped."""
    parts = F.split(F.lower(_c(c)), TOKEN_SPLIT)
    return F.filter(parts, lambda t: t != F.lit(""))


def drop_stop(arr, stop: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """remove stop words, keeping duplicates and order (unlike ``array_except``)."""
    return F.filter(_c(arr), lambda t: ~t.isin(*stop))  # a hash set, not a search through the list for every token


def combined(title, body) -> Column:
    """Title + one space + body."""
    return F.concat_ws(" ", _c(title), _c(body))


def combined_text(title, body) -> Column:
    """Title + space + visible text of the HTML body."""
    return F.concat_ws(" ", _c(title), html_text(body))
