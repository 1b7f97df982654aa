import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.functions.modeljson import answer_object
from tidewire.functions.text import decode_entities, excerpt, fold, slug, strip_html
from tidewire.functions.trigram import similarity
from tidewire.functions.urls import canonical_url, publisher_domain, related
from tidewire.functions.vectors import cosine, cosine_distance


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Www.Example.COM/a/?utm_source=x&b=2&a=1#top", "https://www.example.com/a?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com:80/x//", "http://example.com/x"),
        ("https://example.com:443/?fbclid=1", "https://example.com/"),
        ("https://example.com/p?b=1&a=2&b=0", "https://example.com/p?a=2&b=1&b=0"),
        ("  https://example.com/q?AT_medium=x&id=7 ", "https://example.com/q?id=7"),
        ("javascript:alert(1)", None),
        ("/relative", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert value(spark, canonical_url(F.col("u")), u=raw) == want


def test_canonical_url_is_idempotent(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(canonical_url(F.col("url")).alias("u"))
    assert rows.where(~canonical_url(F.col("u")).eqNullSafe(F.col("u"))).count() == 0


def test_domains(spark):
    assert value(spark, publisher_domain(F.col("u")), u="https://www.example.com:8080/a") == "example.com"
    assert value(spark, related(F.col("a"), F.col("b")), a="news.example.com", b="example.com")
    assert not value(spark, related(F.col("a"), F.col("b")), a="notexample.com", b="example.com")


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=30))
def test_fold_is_idempotent(spark, text):
    once = value(spark, fold(F.col("t")), t=text)
    assert value(spark, fold(F.col("t")), t=once) == once


def test_fold_keeps_accents(spark):
    assert value(spark, fold(F.col("t")), t="  José--O'Brien (2)") == "josé o brien 2"


def test_entities_and_markup(spark):
    assert value(spark, decode_entities(F.col("t")), t="&amp;lt; &#65;&#x42; &#xD800; &#9999999; &copy;") == "&lt; AB &#xD800; &#9999999; &copy;"
    assert value(spark, strip_html(F.col("t")), t="<p>a<b>b</b></p><script>x()</script>\n<style>y</style>&amp;c") == "a b &c"


def test_excerpt(spark):
    assert value(spark, excerpt(F.col("t"), 10, 5), t="aaaa bbbb cccc") == "aaaa bbbb…"
    assert value(spark, excerpt(F.col("t"), 10, 2), t="aaaaaaaaaaaa") == "aaaaaaaaaa…"
    assert value(spark, excerpt(F.col("t")), t=" [a]\n b ") == "(a) b"


def test_slug(spark):
    assert value(spark, slug(F.col("t"), F.col("k")), t="Élan & Größe!", k="0123456789") == "e-lan-gro-e-01234567"
    assert value(spark, slug(F.col("t"), F.col("k")), t="中文", k="abcdefghij") == "story-abcdefgh"


@pytest.mark.parametrize(("a", "b", "want"), [("word", "two words", 0.364), ("Jose", "Jose", 1.0), ("abc", "xyz", 0.0), ("", "", 0.0)])
def test_trigram_similarity(spark, a, b, want):
    assert round(value(spark, similarity(F.col("a"), F.col("b")), a=a, b=b), 3) == pytest.approx(want)


def test_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("z")).alias("z"), cosine_distance(F.col("a"), F.col("z")).alias("d")).first()
    assert math.isclose(row.c, 0.96) and row.z == 0 and row.d is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [('x {"a": 1} y', '{"a": 1}'), ("```json\n{\"a\": 2}\n```", '{"a": 2}'), ('<think>{"b": 1}</think>{"a": 3}', '{"a": 3}'), ('{"a": 1', None), ('<think>{"a": 1}', None), ("[1]", None)],
)
def test_answer_object(spark, raw, want):
    assert value(spark, answer_object(F.col("r")), r=raw) == want


def test_config_bounds():
    assert Config().review == pytest.approx(0.75)
    for bad in ({"similarity": 1.5}, {"promotion_floor": 0}, {"review_merge": 0.95}):
        with pytest.raises(ValueError):
            Config(**bad)
