"""Ordering, crawls, question-answer rows, annotation, files, pages over HTTP, incremental runs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from textloom import schemas, session
from textloom.operators import annotate as A
from textloom.operators import chat, crawl, ordering, qa
from textloom.plans import pipelines
from textloom.sources import files, http, sitemap
from textloom.streaming import incremental


def test_first_occurrence_does_not_depend_on_partitions(spark):
    rows = [(i, i % 7, f"v{i}") for i in range(100)]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "o long, k long, v string").repartition(n)
        assert sorted(tuple(r) for r in ordering.first_occurrence(df, ["k"], ["o"]).collect()) == rows[:7]


def test_numbers_and_required_rows(spark):
    rows = [(i, "" if i % 3 == 0 else f"u{i}", "  " if i == 5 else "t") for i in range(1, 31)]
    df = ordering.numbered(spark.createDataFrame(rows, "o long, url string, text string").repartition(4), "o")
    assert [(r.o, r.row_no) for r in df.orderBy("o").collect()] == [(i, i) for i in range(1, 31)]
    assert [r.o for r in ordering.required(df, 4, 3).collect()] == [4, 7, 8]  # 5 has no text, 6 no url
    with pytest.raises(ValueError):
        ordering.first_n(df, 0, "o")


def test_numbers_of_wide_rows_in_many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(30_000).select(((F.col("id") * 7919) % 30_000).alias("o"), F.repeat(F.lit("x"), 300).alias("_at"), F.col("id").cast("string").alias("t"))
    try:
        for n in ("8", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = ordering.numbered(rows.repartition(40), "o")
            assert df.columns == ["o", "_at", "t", "row_no"]
            assert df.filter(F.col("row_no") != F.col("o") + 1).count() == 0 and df.select("row_no").distinct().count() == 30_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert ordering.numbered(rows.limit(0), "o").count() == 0


def test_latest_first_is_stable(spark):
    rows = [("a", "2024-01-01", 0), ("b", None, 1), ("c", "2024-02-01", 2), ("d", "2024-01-01", 3), ("a", "2024-03-01", 4), ("e", None, 5)]
    df = spark.createDataFrame(rows, "loc string, lastmod string, ord long")
    assert [r.loc for r in ordering.latest_first(df, 10).collect()] == ["a", "c", "d", "b", "e"]


def test_bfs_with_cycles_failures_and_caps(spark):
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "a"), ("b", 1, "d"), ("d", 0, "e"), ("a", 2, "b")], "src string, pos int, dst string")
    got = lambda *x, **kw: sorted(tuple(r) for r in crawl.bfs(edges, *x, **kw).collect())
    assert got(["a"]) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert got(["a"], 1) == [("a", 0), ("b", 1), ("c", 1)]
    assert got(["a"], failed=spark.createDataFrame([("b",)], "url string")) == [("a", 0), ("b", 1), ("c", 1)]
    assert got(["a"], max_pages=2) == [("a", 0), ("b", 1), ("c", 1)]
    visited = crawl.bfs(edges, ["a"], 1)
    assert [r.url for r in crawl.discovered(edges, visited, 3).collect()] == ["b", "c", "a"]


SITEMAP = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.org/n/1 </loc><lastmod>2024-01-01</lastmod></url>
<url><lastmod>2025</lastmod></url><url><loc>https://e.org/n/2?a=1&amp;b=2</loc></url><!-- <url><loc>no</loc></url> --></urlset>"""
INDEX = "<s:sitemapindex xmlns:s='x'><s:sitemap><s:loc>u1</s:loc></s:sitemap><s:sitemap><s:loc>root</s:loc></s:sitemap></s:sitemapindex>"


def test_sitemaps(spark, tmp_path):
    docs = {"root": INDEX, "u1": SITEMAP}
    fetch = lambda us: spark.createDataFrame([(u, docs.get(u)) for u in us], "url string, xml string")
    assert [(r.loc, r.lastmod) for r in sitemap.entries(fetch(["u1"])).collect()] == [("https://e.org/n/1", "2024-01-01"), ("https://e.org/n/2?a=1&b=2", None)]
    assert [r.loc for r in crawl.sitemaps(fetch, "root", r"https://e\.org/n/", 5).collect()] == ["https://e.org/n/1", "https://e.org/n/2?a=1&b=2"]
    (tmp_path / "s.xml").write_text(SITEMAP)
    assert {r.loc for r in sitemap.read_files(spark, str(tmp_path / "s.xml")).collect()} == {"https://e.org/n/1", "https://e.org/n/2?a=1&b=2"}


def test_listing_and_fallback(spark):
    df = spark.createDataFrame([(u,) for u in ("https://e.org/news?page=2", "https://e.org/news", "https://e.org/x/news", "https://o.org/page")], "dst string")
    assert [r.dst for r in crawl.listing_pages(df, "https://e.org/", ["https://e.org/news"]).collect()] == ["https://e.org/news?page=2", "https://e.org/x/news"]
    assert crawl.either(df, lambda: 1 / 0) is df
    assert crawl.either(df.limit(0), lambda: df) is df


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        ('{"a": 1}', [{"a": 1}]),
        ('﻿[{"a": 1}, 2, {"b": 1}]', [{"a": 1}, {"b": 1}]),
        ('{"a":1}{"a":2},\n{"a":3}', [{"a": 1}, {"a": 2}, {"a": 3}]),
        ('[{"a":1}][{"a":2}] {"c":1}', [{"c": 1}]),
        ("7", []),
    ],
)
def test_json_framing(text, want):
    assert [json.loads(x) for x in files.json_objects(text)] == want


def test_json_garbage(spark, tmp_path):
    with pytest.raises(json.JSONDecodeError):
        list(files.json_objects('{"a":1} oops'))
    assert len(list(files.json_objects('{"a":1} oops', strict=False))) == 1
    (tmp_path / "x.json").write_text('{"pairs":[{"question":"q","answer":"a"}]}{"pairs":[]}')
    assert [(r.idx, json.loads(r.obj)) for r in files.read_json_objects(spark, str(tmp_path / "x.json")).orderBy("idx").collect()] == [(0, {"pairs": [{"question": "q", "answer": "a"}]}), (1, {"pairs": []})]


def test_flatten(spark):
    objs = [
        {"pairs": [{"question": " “q” ", "answer": "'a'"}, {"question": "q", "answer": "a"}, 7, {"question": "q"}, {"question": "", "answer": "a"}, {"question": None, "answer": "a"}]},
        {"pairs": "x"},
        {"none": 1},
        {"pairs": [{"question": "q", "answer": "b"}, {"question": 42, "answer": True}, {"question": "q", "answer": "a"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objs)], "idx long, obj string")
    got = lambda **kw: sorted((r.question, r.answer) for r in pipelines.flattened(df, **kw).collect())
    assert got() == [("42", "true"), ("q", "a"), ("q", "b")]
    assert got(deduplicate=False) == [("42", "true"), ("q", "a"), ("q", "a"), ("q", "a"), ("q", "b")]


def test_chat(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "system", ""), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.text for r in chat.with_text(chat.conversations(df)).collect()}
    assert got == {1: "<|system|>\n<|end|>\n<|assistant|>\nb<|end|>\n", 2: "<|user|>\n<|end|>\n"}
    t = chat.Template("B", "[{role}]", "/", "[bot]")
    assert pipelines.training_text(spark.createDataFrame([("q", "a")], schemas.QA), t).first()["text"] == "B[user]q/[assistant]a/"


class Scripted:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def generate(self, prompt, temperature):
        self.calls.append((prompt, temperature))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_retries_and_reasks():
    slept = []
    busy = [A.ProviderError("busy", 429), A.ProviderError("busy", 503), A.ProviderError("late", timeout=True), TimeoutError()]
    assert A.ask(Scripted(*busy, '{"pairs": []}'), "p", A.Settings(), slept.append) == {"pairs": []}
    assert slept == [2, 4, 8, 16]
    with pytest.raises(A.ProviderError):
        A.ask(Scripted(A.ProviderError("bad", 400)), "p", A.Settings(), slept.append)
    with pytest.raises(A.ProviderError):
        A.ask(Scripted(*[A.ProviderError("busy", 503)] * 5), "p", A.Settings(), slept.append)
    p = Scripted("no", '{"pairs": [', '```json\n{"pairs": [1]}\n```')
    assert A.ask(p, "p", A.Settings(), slept.append) == {"pairs": [1]}
    assert [t for _, t in p.calls] == [0.0, 0.2, 0.2] and p.calls[1][0].startswith("p\n\n")
    with pytest.raises(A.FormatError) as e:
        A.ask(Scripted("a", "b", "c"), "p", A.Settings(), slept.append)
    assert e.value.raw_text == "c"


def test_response_shapes():
    r = A.Response(candidates=[{"parts": []}, {"parts": [{"text": '{"a"'}, {"text": ": 1}"}], "finish_reason": "STOP"}, {"finish_reason": "MAX"}])
    assert A.payload(r) == {"a": 1} and A.finish_reason(r) == "STOP, MAX"
    assert A.payload(A.Response(parsed={"b": 2}, text="x")) == {"b": 2}
    with pytest.raises(A.FormatError):
        A.payload(A.Response())
    assert A.json_object('text {"a": {"b": 1}} more') == {"a": {"b": 1}}


def test_extract_json_column(spark):
    raw = ['```json\n{"a":1}\n```', '{"a":2}', 'see {"a":3} there', "none"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [x[0] for x in df.select(A.extract_json("r")).collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', "none"]


def test_annotate_gives_one_row_a_row(spark):
    class Mixed:
        def generate(self, prompt, temperature):
            if "title: bad" in prompt:
                raise A.ProviderError("no", 400)
            if "title: null" in prompt:
                return '{"pairs": null}'
            if "title: junk" in prompt:
                return "junk"
            return {"pairs": [{"question": "q", "answer": "a", "extra": 1}, 7]}

    rows = [(i + 1, "s", t, None, f"u{i}" if t != "skip" else "", "text") for i, t in enumerate(["ok", "skip", "bad", "null", "junk", "late"])]
    df = spark.createDataFrame(rows, "row_no long, source string, title string, published_at string, url string, text string")
    got = pipelines.annotated(df, Mixed, max_rows=4, settings=A.Settings(ask_delay=0)).collect()
    assert {r.title: (len(r.pairs), r.error is not None, r.raw_model_text) for r in got} == {"ok": (1, False, None), "bad": (0, True, None), "null": (0, False, None), "junk": (0, True, "junk")}


def test_violations_and_schema(spark):
    good = ("q", "a", "neutral", "s", ["x"], True, "low")
    rows = [([good],), (None,), ([good] * 4,), ([("q", None, "odd", "s", [], True, "none")],)]
    df = spark.createDataFrame(rows, f"p array<{schemas.PAIR.simpleString()}>")
    assert [r[0] for r in df.select(A.violations("p")).collect()] == [[], ["pairs_missing"], ["too_many_pairs"], ["field_missing", "stance_unknown", "risk_unknown", "quotes_out_of_range"]]
    s = A.ordered(A.json_schema())
    assert s["propertyOrdering"] == ["pairs"] and s["properties"]["pairs"]["items"]["propertyOrdering"][0] == "question"
    assert "propertyOrdering" not in A.json_schema()


def test_article_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes('﻿text,url,title,extra\r\n"He said ""hi"", ok\nline\\",u1,t,e\r\n,u2,,\r\n'.encode())
    df = files.read_articles_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["source", "title", "published_at", "url", "text"]
    assert [(r.source, r.title, r.url, r.text) for r in df.collect()] == [(None, "t", "u1", 'He said "hi", ok\nline\\'), (None, None, "u2", None)]
    files.write_articles_csv(df, str(tmp_path / "out"), one_file=True)
    assert sorted(map(str, files.read_articles_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    files.write_articles_csv(df.limit(0), str(tmp_path / "none"), one_file=True)
    assert [p.read_text() for p in (tmp_path / "none").glob("*.csv")] == ["source,title,published_at,url,text\n"]


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é “q”", "a\nb")], schemas.QA)
    files.write_qa_csv(df, str(tmp_path / "qa"), one_file=True)
    assert [p.read_text() for p in (tmp_path / "qa").glob("*.csv")] == ['"question","answer"\n"é “q”","a\nb"\n']
    for _ in range(2):
        files.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "j"), schemas.QA).count() == 2
    rows = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert files.not_yet_written(rows, str(tmp_path / "done")).count() == 2
    files.write_jsonl(rows.limit(1), str(tmp_path / "done"))
    assert files.not_yet_written(rows, str(tmp_path / "done")).count() == 1
    seen, counts = files.counted(df, "c1", asked=F.col("question") != "")
    seen.collect()
    assert counts.get == {"rows": 1, "asked": 1}
    assert "\n" in files.pretty(df).first()[0]
    assert files.one_article(spark, url="u", text="t").first().asDict() == {"source": None, "title": None, "published_at": None, "url": "u", "text": "t"}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport A_KEY='v'\nB=1\n")
    env = session.load_env(tmp_path / ".env")
    assert env["A_KEY"] == "v" and env["B"] == "1" and session.require("A_KEY", env) == "v"
    with pytest.raises(RuntimeError):
        session.require("TEXTLOOM_NONE", env)


class Pages(BaseHTTPRequestHandler):
    tries: dict = {}

    def do_GET(self):
        n = self.tries[self.path] = self.tries.get(self.path, 0) + 1
        code = 503 if self.path == "/flaky" and n < 3 else 404 if self.path == "/none" else 200
        body = "<p>caf\xe9</p>".encode("latin-1")
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=iso-8859-1")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        policy = http.Policy(backoff=0, retries=3, delay=0)
        df = spark.createDataFrame([(f"{base}/{p}",) for p in ("ok", "flaky", "none")], "url string")
        got = {r.url.rsplit("/", 1)[1]: r for r in http.fetch(df, lambda: http.providers("requests", policy)).collect()}
        assert got["ok"].html == got["flaky"].html == "<p>café</p>" and got["ok"].status == 200
        assert got["none"].html is None and "404" in got["none"].error
        http.register(spark)
        rows = spark.read.format("textloom_http").options(urls=f"{base}/ok {base}/none", mode="requests", backoff=0, delay=0).load().collect()
        assert sorted((r.status or 0, r.error is None) for r in rows) == [(0, False), (200, True)]
    finally:
        server.shutdown()
    chain = [http.StoredProvider({}), http.StoredProvider({"u": "x"})]
    assert http.first_page(chain, "u") == (200, "x", None)
    assert http.first_page(chain, "v")[2].endswith("404")
    with pytest.raises(ValueError):
        http.providers("other")


def test_incremental_drops(spark, tmp_path):
    drop, out, state = tmp_path / "drop", tmp_path / "out", tmp_path / "state"
    drop.mkdir()
    text = "t" * 300
    for n in (1, 2):
        (drop / f"{n}.csv").write_text(f"source,title,published_at,url,text\ns,t,,u{n},{text}\ns,t,,u1,{text}\n")
        stream = incremental.first_seen(incremental.article_drops(spark, str(drop)))
        incremental.run(stream, lambda df: df.filter(F.length("text") >= 200).select("url"), str(out), str(state)).awaitTermination(120)
        assert sorted(r.url for r in spark.read.json(str(out)).collect()) == [f"u{i}" for i in range(1, n + 1)]


def test_window_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.counts_by_window(events).agg(F.sum("n")).first()[0] == events.count()
