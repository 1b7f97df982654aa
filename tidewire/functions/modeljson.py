"""Tolerant reading of a model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_object(raw: Column) -> Column:
    """The JSON object of an answer as text, or null: thinking blocks (closed or not) are dropped, then a fenced block is tried, then the outermost braces."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(think|thought)>.*?</\1>", " "), r"(?is)<(think|thought)>.*$", " ")
    fenced = F.regexp_extract(bare, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    bare_text = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    is_object = lambda c: F.when(bare_text(c).startswith("{") & F.try_parse_json(bare_text(c)).isNotNull(), bare_text(c))
    return F.coalesce(is_object(fenced), is_object(braces))
