"""Text functions: folding, titles, markup, excerpts, hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The named character references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def fold(name: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


normalize_title = fold


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _references(text: str | None) -> str | None:
    if text is None or "&" not in text:
        return text

    def number(digits: str, base: int) -> str | None:
        value = int(digits, base)
        return chr(value) if 0 < value <= 0x10FFFF and not 0xD800 <= value <= 0xDFFF else None

    text = re.sub(r"&#([0-9]+);", lambda m: number(m[1], 10) or m[0], text)
    text = re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: number(m[1], 16) or m[0], text)
    return re.sub(r"&([A-Za-z]+);", lambda m: NAMED.get(m[1].lower(), m[0]), text)


def _mapped(function: Callable[[str | None], str | None], text: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return run(text)


def decode_entities(text: Column) -> Column:
    """Numeric, then named character references, each decoded once; impossible code points stay."""
    return _mapped(_references, text)


def strip_html(html: Column) -> Column:
    """Text of a page: script and style out, tags to spaces, references decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, r"<[^>]*>", " ")))


def excerpt(text: Column, limit: int = 1500, slack: int = 200) -> Column:
    """At most ``limit`` characters, cut at a space in the last ``slack`` of them where there is one, with an ellipsis; square brackets become round."""
    clean = F.translate(collapse(text), "[]", "()")
    head = F.substring(clean, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    at_space = (F.locate(" ", F.reverse(head)) > 0) & (space - 1 > limit - slack)
    cut = F.when(at_space, F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(cut, F.lit("…")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _plain(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text)


def decompose(text: Column) -> Column:
    """Compatibility decomposition (NFKD)."""
    return _mapped(_plain, text)


def slug(title: Column, key: Column, normal: Callable[[Column], Column] = decompose) -> Column:
    """Lower-case ASCII words joined by hyphens, 60 characters at most, and the first eight characters of the key."""
    words = F.regexp_replace(F.regexp_replace(normal(F.lower(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(words, 1, 60), "-+$", "")
    return F.concat(F.when(short == "", F.lit("story")).otherwise(short), F.lit("-"), F.substring(key, 1, 8))
