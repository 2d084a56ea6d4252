"""Text analysis for the search index: tokenizer, HTML escaping, title picking helpers."""

from __future__ import annotations

import functools
import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the default analyser: a token is a maximal run of letters/digits, tokens of 40 bytes or more are
# dropped, the rest lower-cased. BM25 constants k1, b. First year of the year facet.
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
NO_TOKEN_PATTERN = r"[^\p{L}\p{N}]+"
MAX_TOKEN_BYTES = 40
BM25_K1 = 1.2
BM25_B = 0.75
FIRST_FACET_YEAR = 2004


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text) -> Column:
    """All letter/digit runs of a text, in order (array<string>; empty for NULL)."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_PATTERN), 1)


def spaced_tokens(text) -> Column:
    """The same runs as ``raw_tokens`` in one string, a space between them (empty for NULL): one value per text to build
    and pass on, where the array has one per token."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), NO_TOKEN_PATTERN, " "))


def keep_token(tok) -> Column:
    return F.octet_length(tok) < MAX_TOKEN_BYTES


def analyse(text) -> Column:
    """T3 without positions: lower-cased tokens shorter than 40 bytes."""
    return F.transform(F.filter(raw_tokens(text), keep_token), F.lower)


def html_escape(s) -> Column:
    """Escape & < > (ampersand first)."""
    return F.replace(F.replace(F.replace(_col(s), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


# A character reference: decimal, hexadecimal or by name.
CHARREF_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


@functools.lru_cache(maxsize=1)
def _named_references() -> str:
    """All named references, and the numeric ones that do not mean their own code point, as the standard library knows
    them, as JSON."""
    named = {f"&{k}": v for k, v in html.entities.html5.items()}
    odd = {f"&#{n};": html.unescape(f"&#{n};") for n in [0, 13, *range(0x80, 0xA0)]}
    return json.dumps(named | odd)


def html_unescape(s) -> Column:
    """Character references decoded: every named one of HTML 5 (with its semicolon, or without where the standard allows
    that), decimal and hexadecimal ones. What is no reference stays as it is."""
    named = F.from_json(F.lit(_named_references()), "map<string,string>")

    def number(n):
        shown = F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(named, F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))), shown)

    def decode(r):
        digits = F.regexp_replace(r, "[&#;xX]", "")
        # numbers of more digits than a code point has are none
        short = F.length(F.regexp_replace(digits, "^0+", "")) <= 8
        return (F.when(r.rlike("^&#[xX]"), number(F.when(short, F.conv(digits, 16, 10).cast("long"))))
                .when(r.startswith("&#"), number(F.when(short, digits.cast("long"))))
                .otherwise(F.coalesce(F.try_element_at(named, r), r)))

    text = _col(s)
    refs = F.transform(F.regexp_extract_all(text, F.lit(CHARREF_PATTERN), 0), decode)
    return F.array_join(F.zip_with(F.split(text, CHARREF_PATTERN, -1), F.concat(refs, F.array(F.lit(""))),
                                   lambda t, r: F.concat(t, r)), "")


def first_line(text) -> Column:
    """Title of a plain-text body: its first line."""
    return F.substring_index(_col(text), "\n", 1)
