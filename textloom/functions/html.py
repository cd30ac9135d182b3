"""Marked-up text to plain text, entirely with native Spark expressions.

The entity table is the standard library's HTML5 table, handed to the plan as one constant map, so
no text crosses into a Python worker.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import as_column, let, squeeze

# What a character reference looks like, and the names that are looked up first
# because they make up nearly all references in real pages (the map is searched in order).
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
FREQUENT_NAMES = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "middot;", "apos;", "rsquo;")

# Elements whose text is not part of the document text.
SILENT_ELEMENTS = "script|style|template|rt|rp"

# Attributes: a name, then perhaps "=" and a value. Only a quote straight after "=" opens a quoted
# value, which may hold ">". A leading "=" belongs to the name. Possessive, so that Java neither
# backtracks nor recurses.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_ATTRIBUTES = rf"""(?:[\s/]++|(?:(?<=[\s/"'])=)?+[^\s/>=]++(?>\s*+=\s*+{_VALUE}|(?!\s*+=)))*+"""

# Comments, silent elements and tags in one left-to-right pass: a comment opener inside a script,
# or a tag inside a comment, must not be seen on its own.
MARKUP = (
    r"(?is)<!--.*?(?:--!?>|\z)"
    rf"|<({SILENT_ELEMENTS})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|<[/!?]?[a-z][^\s/>]*+{_ATTRIBUTES}>"
)

SPACE_BEFORE_PUNCTUATION = r" ([.,!?;:])"


@lru_cache(maxsize=1)
def _named_table() -> str:
    ordered = {name: html5[name] for name in FREQUENT_NAMES}
    ordered.update(html5)
    return json.dumps(ordered)


@lru_cache(maxsize=1)
def _legacy_prefix() -> str:
    """Names that count even without a semicolon, longest first."""
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(" + "|".join(legacy) + ")"


@lru_cache(maxsize=1)
def _c1_table() -> str:
    """References to the C1 range mean Windows-1252; bytes it leaves open stay as they are."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[str(code)] = chr(code)
    return json.dumps(table)


def _constant_map(table_json: str) -> Column:
    return F.from_json(F.lit(table_json), "map<string,string>")


def _utf16_hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 4, "0")


def _character(code: Column) -> Column:
    """The character of a code point, as references define it."""
    astral = code - F.lit(0x10000)
    units = F.when(code < 0x10000, _utf16_hex(code)).otherwise(
        F.concat(
            _utf16_hex(F.lit(0xD800) + F.shiftright(astral, 10)),
            _utf16_hex(F.lit(0xDC00) + astral.bitwiseAND(0x3FF)),
        )
    )
    dropped = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�"))
        .when(
            code.between(0x80, 0x9F),
            F.try_element_at(_constant_map(_c1_table()), code.cast("string")),
        )
        .when(dropped, F.lit(""))
        .otherwise(F.decode(F.unhex(units), "UTF-16BE"))
    )


def _numeric(ref: Column) -> Column:
    is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    padded = F.when(digits == "", F.lit("0")).otherwise(digits)
    # Longer than any code point: out of range whatever the digits are.
    code = (
        F.when(F.length(padded) > 7, F.lit(0x110000).cast("bigint"))
        .when(is_hex, F.conv(padded, 16, 10).cast("bigint"))
        .otherwise(F.try_to_number(padded, F.lit("9999999")).cast("bigint"))
    )
    return _character(code)


def _named(ref: Column) -> Column:
    name = F.substring(ref, 2, 40)
    table = _constant_map(_named_table())
    prefix = F.regexp_extract(name, _legacy_prefix(), 1)
    by_prefix = F.when(
        prefix != "",
        F.concat(
            F.try_element_at(table, prefix), F.substring(name, F.length(prefix) + 1, F.lit(40))
        ),
    )
    return F.coalesce(F.try_element_at(table, name), by_prefix, ref)


def decode_entities(c: Column | str) -> Column:
    """Replace named and numeric character references once, over the whole string."""
    return let(as_column(c), _decode)


def _decode(c: Column) -> Column:
    decoded = F.array_join(
        F.zip_with(
            F.split(c, REFERENCE),
            F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)),
            # One more piece than references: the last pairing has none.
            lambda piece, ref: F.when(ref.isNull(), piece).otherwise(
                F.concat(
                    piece,
                    F.when(F.startswith(ref, F.lit("&#")), _numeric(ref)).otherwise(_named(ref)),
                )
            ),
        ),
        "",
    )
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_markup(c: Column | str) -> Column:
    """Comments, silent elements and tags each become one space."""
    return F.regexp_replace(as_column(c), MARKUP, " ")


def clean_html(c: Column | str) -> Column:
    """Plain text of a marked-up description; null gives the empty string.

    References are decoded before the tags are dropped (an escaped tag is a tag) and once more
    afterwards (the text of the document is itself escaped).
    """
    text = decode_entities(F.coalesce(as_column(c), F.lit("")))
    text = decode_entities(strip_markup(text))
    text = F.regexp_replace(squeeze(text), SPACE_BEFORE_PUNCTUATION, "$1")
    return F.trim(text)
