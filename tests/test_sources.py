import html
import io
import re
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.sources import feeds, readable, seed
from tidewire.sources.providers import embedded, mock_embeddings, mock_series

RSS = """<rss version="2.0"><channel><title>T</title>
<item><title>One &amp; two</title><link>https://a.example/1?x=1&amp;y=2</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>short</description><content:encoded><![CDATA[<p>long <b>text</b></p>]]></content:encoded></item>
<item><title>Two</title><guid>https://a.example/2</guid><dc:date>2024-01-02</dc:date></item></channel></rss>"""


def test_rss(spark):
    rows = feeds.rss_items(spark.createDataFrame([(RSS,), ("<html/>",)], "xml string")).orderBy("position").collect()
    assert [(r.title, r.link, r.body) for r in rows] == [("One & two", "https://a.example/1?x=1&y=2", "long text"), ("Two", "https://a.example/2", None)]
    assert rows[1].published == "2024-01-02"
    assert feeds.not_rss(spark.createDataFrame([(RSS,), ("<html/>",)], "xml string")).count() == 1


def test_rss_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.replace("content:encoded", "body").replace("dc:date", "date"))
    assert feeds.read_rss_files(spark, str(tmp_path)).count() == 2


def line(**fields):
    cells = [""] * feeds.FIELDS
    for k, v in fields.items():
        cells[feeds.GKG[k]] = v
    return ("\t".join(cells),)


def test_gkg(spark):
    lines = [
        line(record="1", seen="20240101120000", domain="News.Example", tone="-1.5,2", persons="Ann, B,12;Bad,x;,3", locations="1#Paris#FR###48.8#2.3#F1#40;1#Void#FR#####F2#9;1#Far#FR###99#2#F3#5;1#Odd#FR###x#2#F4#5"),
        line(record="2", seen="20240231120000"),
        ("3\tshort",),
    ]
    rows = feeds.gkg_rows(spark.createDataFrame(lines, "value string"))
    by = {r.record: r for r in rows.collect()}
    assert by["1"].domain == "news.example" and by["1"].tone == -1.5 and by["2"].seen_at is None and by["3"].malformed and by["3"].url is None
    found = {(r.kind, r.surface_name, r.char_offset, r.location_detail.latitude if r.location_detail else None) for r in feeds.annotations(rows).collect()}
    assert found == {("person", "Ann, B", 12, None), ("location", "Paris", 40, 48.8), ("location", "Void", 9, None)}
    assert not feeds.file_rejected(rows) and feeds.file_rejected(rows.where("malformed"))


def test_stamp_never_rolls_over(spark):
    rows = spark.createDataFrame([("20240229000000",), ("20230229000000",), ("2024",), (None,)], "s string").select(feeds.stamp(F.col("s")).alias("t")).collect()
    assert [r.t is not None for r in rows] == [True, False, False, False]


def test_archives(spark, tmp_path):
    def put(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, text in members.items():
                z.writestr(m, text)

    put("good.zip", {"a.csv": "x\ty\nz\n"})
    put("two.zip", {"a.csv": "1", "b.csv": "2"})
    (tmp_path / "bad.zip").write_bytes(io.BytesIO(b"no zip").getvalue())
    rows = feeds.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.failure, r.value) for r in rows if r.failure is None) == [("good.zip", None, "x\ty"), ("good.zip", None, "z")]
    assert {r.failure for r in rows if r.failure} == {"archive out of bounds", "not an archive"}


def test_requests():
    assert "maxrecords=250" in feeds.list_request("https://x.example/doc?query=a&maxrecords=9")
    with pytest.raises(ValueError):
        feeds.list_request("https://x.example/doc?mode=artlist")
    listing = "1 a http://x.example/1.export.csv.zip\n2 b http://x.example/1.gkg.csv.zip"
    assert feeds.window_url(listing, "x.example") == "http://x.example/1.gkg.csv.zip"
    with pytest.raises(ValueError):
        feeds.window_url(listing, "y.example")


def test_main_text(spark):
    page = "<nav>menu menu menu menu menu menu</nav><p>" + "word " * 200 + "</p><p><a>link link link link link link link</a></p>"
    row = spark.createDataFrame([(page, "<p>short</p>")], "a string, b string").select(feeds.main_text(F.col("a")).alias("a"), feeds.main_text(F.col("b")).alias("b")).first()
    assert row.a.startswith("word word") and "link" not in row.a and "menu" not in row.a and row.b is None


STORY = [f"Paragraph {k} tells what happened, who was there, and what they said about it in the end." for k in range(6)]
NOISE = "Sign up for our daily letter, follow us, and read what others say about this and that."


def page_of(body):
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{body}</body></html>"


PAGES = {
    "sidebar": page_of(f"<div id=sidebar><p>{NOISE}</p><p>{NOISE}</p></div><div class=content>{''.join(f'<p>{x}</p>' for x in STORY)}</div><div class='comments'><p>{NOISE}</p></div>"),
    "nested": page_of(f"<div><div><div class=story-body>{''.join(f'<div><p>{x}</p></div>' for x in STORY)}</div></div><div><ul>{''.join(f'<li><a href=/{k}>{NOISE}</a></li>' for k in range(9))}</ul></div></div>"),
    "unclosed": f"<body><nav><a href=/>{NOISE}</a></nav><div>{''.join(f'<p>{x}' for x in STORY)}</div><footer><p>{NOISE}</footer>",
    "breaks": page_of(f"<table><tr><td>{'<br>'.join(STORY)}</td><td><a href=/>{NOISE}</a></td></tr></table>"),
    "siblings": page_of(f"<div><p>{STORY[0]}</p><div>{''.join(f'<p>{x}</p>' for x in STORY[1:5])}</div><p>{STORY[5]}</p><p><a href=/>{NOISE}</a></p></div>"),
    "inline": page_of(f"<main>{''.join(f'<p><b>{x[:20]}</b><i>{x[20:]}</i></p>' for x in STORY)}<ul><li><a href=/>{NOISE}</a></ul></main>"),
    "names": page_of(f"<article class='post ad-free'>{''.join(f'<p>{x}</p>' for x in STORY)}</article><div class=relatedStories><p>{NOISE}</p></div><div class=promoBox><p>{NOISE}</p></div>"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_by_the_tree(name):
    assert readable.main_text(PAGES[name]) == " ".join(STORY)


def test_main_text_of_odd_pages():
    assert readable.main_text(None) == readable.main_text("") == readable.main_text("<script>var x</script>") == ""
    assert readable.main_text("no tags, but a sentence that is long enough") == "" and readable.main_text("</p></div><p>") == ""
    began = time.monotonic()
    readable.main_text("<b>" * 50_000 + "x" + "</i>" * 50_000 + "<div>" * 5_000 + f"<p>{STORY[0]}" * 200)
    readable.main_text("<p>Short one.</p>" * 20_000 + f"<div>{''.join(f'<p>{x}</p>' for x in STORY)}</div>")
    assert time.monotonic() - began < 20


def test_main_text_of_the_given_pages(spark):
    """Precision and recall, by words, against the text of the pages' article elements."""
    shares = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = Counter(html.unescape(re.sub("<[^>]*>", " ", re.search("(?s)<article>(.*?)</article>", r.html)[1])).split())
        got = Counter(readable.main_text(r.html).split())
        both = (want & got).total()
        shares.append((both / max(1, got.total()), both / max(1, want.total())))
    assert min(np.mean(shares, axis=0)) > 0.99


def test_mock_embeddings(spark):
    a = mock_embeddings(["x", "x", "y", ""], 16)
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and (a[0] == a[1]).all() and (a[0] != a[2]).any()
    rows = spark.createDataFrame([("x",), (None,)], "t string").select(embedded(F.col("t"), lambda t: mock_embeddings(t, 8), 4).alias("v")).collect()
    assert len(rows[0].v) == 4 and rows[1].v is None and np.isclose(np.linalg.norm(rows[0].v), 1)


def test_mock_series(spark):
    rows = mock_series(spark, ["A", "B"], 370, "2024-06-28")
    assert rows.groupBy("ticker").count().where("count > 250").count() == 2 and rows.exceptAll(mock_series(spark, ["A", "B"], 370, "2024-06-28")).count() == 0


def test_seed_is_idempotent(spark):
    articles = seed.seed_articles(spark)
    assert (seed.seed_stories(spark).count(), articles.count(), articles.select("url").distinct().count(), seed.seed_places(spark).count()) == (12, 27, 27, 22)
    once = seed.loaded(schemas.empty(spark, "articles"), articles, "url")
    assert once.count() == seed.loaded(once, articles, "url").count() == 27
    assert articles.groupBy("slug").agg(F.countDistinct("publisher_id").alias("n")).where("n < 2").count() == 0


def test_schemas(spark):
    assert all(schemas.empty(spark, t).count() == 0 for t in schemas.TABLES)


def test_request_and_window_columns_follow_the_plain_ones(spark):
    urls = ["https://x.example/doc?query=a&maxrecords=9", "https://x.example/doc?mode=x&query=a&mode=y&sort=new", "https://x.example/doc?query=a&format=json&maxrecords=1", "https://x.example/doc?mode=artlist", "https://x.example/doc", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(feeds.list_requests(F.col("u"))).collect()]
    assert got == [feeds.list_request(u) for u in urls[:3]] + [None] * 4
    listings = ["1 a http://x.example/0.gkg.csv.zip\r\n2 b http://X.example/1.gkg.csv.zip\n3 c http://x.example/1.export.csv.zip\n", "1 a http://y.example/1.gkg.csv.zip", "nothing", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in listings], "x string").select(feeds.window_urls(F.col("x"), "x.example")).collect()]
    assert got == [feeds.window_url(listings[0], "x.example"), None, None, None, None]


def test_a_reference_cut_off_before_its_semicolon_stays(spark):
    page = f"<article><h1>Ham &amp;&amp; eggs&amp</h1><p>{STORY[0]} &eacute;&#65;&ampx; &#66 &lt;b&gt;</p></article>"
    assert readable.main_text(page) == f"Ham && eggs&amp {STORY[0]} éA&ampx; &#66 <b>"
