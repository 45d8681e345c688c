"""Registered queries against their SQL on rows that the tables hardly hold."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import check

from textloom import queries as Q
from textloom.functions import pages, text


@pytest.mark.parametrize("name", ["crawl_collected", "html_text", "html_longest"])
def test_pages_match_sql(spark, tmp_path, name):
    """Addresses that two pages share; titles cut within a reference."""
    page = "<html><head><title>x</title></head><body><h1>{}</h1><article>{}</article></body></html>"
    body = "".join(f"<p>{n} A sentence that is long enough to be kept as text &amp; more.</p>" for n in range(5))
    titles = ["token = &quot", "a &quot;b&quot; &amp", "c &copy d", "e &amp f &am"]
    html = [page.format(t, "".join(f"<p>{t}</p>") + body) for t in titles]
    pq.write_table(pa.table({"page_id": range(4), "url": ["https://e.org/same", "https://e.org/same", "https://e.org/2", "https://e.org/3"], "html": html}), f"{tmp_path}/pages.parquet")
    assert check(spark, Q.QUERIES[name], Q.SQL[name], str(tmp_path)) >= 4


def test_open_references():
    page = "<h1>a &quot b &copy; &copyx &ampc &#39; &#39 &notin; &nosuch; & d</h1>"
    assert pages.parse(page)["h1"] == 'a " b © ©x &c \' \' ∉ &nosuch; & d'
    assert pages.parse(page, open_references=False)["h1"] == "a &quot b © &copyx &c ' &#39 ∉ &nosuch; & d"


TEXT = "A sentence of words, one. Another and.\nsecond line of it, too."
ODD = ["", None, " ", "\n", "\n\n\n", "\t", "\n" + TEXT, "\n\n " + TEXT, " \n" + TEXT, TEXT + "\n", TEXT + " \t", TEXT + "\n\n", TEXT + " \n \n \n \n" + TEXT, TEXT + "e\u0301", "\u0301" + TEXT, '"', '""', f'"{TEXT}"', TEXT + "\\", TEXT + '\\"', ",", "a\n,\"b\"", "null", "\\N", "#x"]
AS_CSV = [*ODD, TEXT + "\r\n" + TEXT, "\r" + TEXT, TEXT + "\r", "\x00" + TEXT, "\x01" + TEXT + "\x01", "\ufeff" + TEXT, "\xa0" + TEXT + "\u2028"]


@pytest.mark.parametrize("name,texts", [("csv_articles", AS_CSV), ("nfkc", ODD)])
def test_texts_match_sql(spark, tmp_path, name, texts):
    """Texts that are empty, begin or end with white space, or hold what CSV gives a meaning."""
    n = len(texts)
    pq.write_table(pa.table({"doc_id": range(n), "text": texts, "lang": ["en", "", None, " x "] * (n // 4) + ["en"] * (n % 4), "source": ["src1"] * n}), f"{tmp_path}/documents.parquet")
    assert check(spark, Q.QUERIES[name], Q.SQL[name], str(tmp_path)) == n


def test_slices_keep_every_text():
    texts = pa.array(["", "a" * 9, None, "bb", "c" * 3, "d", ""])
    parts = [p.to_pylist() for p in text.slices(texts, 4)]
    assert parts == [[""], ["a" * 9], [None, "bb"], ["ccc", "d", ""]]
    assert list(text.slices(texts.slice(0, 0), 4)) == [] and sum(parts, []) == texts.to_pylist()


def test_pages_are_parsed_in_slices(spark):
    """However many pages an Arrow batch has, no more bytes of them than a slice are parsed at a time."""
    html = [f"<h1>{n}</h1>" + "x" * (pages.SLICE // 3) for n in range(8)]
    parts = [p.to_pylist() for p in pages.parse_batches(iter([pa.array([*html, None])]))]
    assert [len(p) for p in parts] == [2, 2, 2, 3] and [r["h1"] for p in parts for r in p] == [*"01234567", None]
    df = spark.createDataFrame([(h,) for h in [*html, None]], "h string").coalesce(1)
    assert [r[0] for r in df.select(pages.parsed("h")["h1"]).collect()] == [*"01234567", None]


def test_white_space_and_lines_are_pythons(spark):
    """Random texts of white space and line ends of all kinds, against Python's own; each text is split once."""
    rng = random.Random(5)
    some = "ab \t\n\n\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　​\x00"
    texts = ["".join(rng.choices(some, k=rng.randint(0, 24))) for _ in range(3000)] + ["", "\n", "a\n", "\r\n", "a \n\n\n b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.strip("t").alias("a"), text.lines("t").alias("b"), text.boilerplate("t").alias("c"), text.boilerplate("t", drop=["A"]).alias("d"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2

    def boilerplate(t, drop):
        kept = [s for s in t.replace("\x00", " ").strip().splitlines() if not s.strip().startswith(drop)]
        return re.sub("\n{3,}", "\n\n", "\n".join(s if s.strip() else "" for s in kept)).strip()

    for t, *row in got.collect():
        assert row == [t.strip(), t.splitlines(), boilerplate(t, "none"), boilerplate(t, "a")], repr(t)
