"""Main text of pages: boilerplate out, the article whole."""

import html as std
import itertools
import random
import re
import time

import pytest

from textloom.llm import html as H

PARA = "The first long paragraph of the text, which is in English and has a number of the usual words that you would find in it, as it is for the reader and all of them were there with it and so on and on."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>c</p> -->", ""),
        ("<article><h1>T</h1><p>a &amp; b&nbsp;&#233; <b>bold</b>\n c</p></article>", "T a & b é bold c"),
        ("<nav>menu</nav><main><p>one<p>two<br>three</main><footer>f</footer>", "one two three"),
        ("<article><p>in</p><div class='ad'>buy</div><aside>side</aside><form>f<input></form><p>out</p></article><div id=comments><p>c</p></div>", "in out"),
        ("<article><header><h1>Head</h1></header><p>x</p><section class='comments'><p>me too</p></section></article>", "Head x"),
        ("<article class='post'><p>post</p></article><article class='comment'><p>reply</p></article>", "post"),
        ("<article><p>a<b>b<br><p>c</p></article><p>d", "ab c"),
        ("<article><p title='a > b'>x < y</p><p hidden>h</p><div style='display:none'>n</div></article>", "x < y"),
        ("<article><div class='cookie-notice'>c</div><div role=navigation>n</div><p>loadable header-free</p></article>", "loadable header-free"),
        ("<article><p>unclosed <!-- comment", "unclosed"),
        ("<p>only a short text", "only a short text"),
    ],
)
def test_cases(page, want):
    assert H.main_text(page) == want


def test_without_marks_blocks_decide():
    page = f"<div class=menu><a href=x>Home</a> <a href=y>News</a></div><h1>Heading</h1><div><p>{PARA}</p><p>Short one.</p><p>{PARA}</p></div><ul><li><a href=q>link of the site and more of it</a></li></ul><div class=foot>Impressum</div>"
    assert H.main_text(page) == f"Heading {PARA} Short one. {PARA}"


def test_nothing_is_lost_in_marked_articles():
    rng = random.Random(1)
    for _ in range(300):
        parts, want = [], []
        for _ in range(rng.randrange(1, 8)):
            text = " ".join(rng.choice(["the", "wörd", "a&b", "x<y", "3", "é"]) for _ in range(rng.randrange(1, 30)))
            tag = rng.choice(["p", "div", "li", "blockquote", "h2", "section"])
            parts.append(f"<{tag}>{std.escape(text)}" + rng.choice([f"</{tag}>", ""]) * (tag not in ("div", "section", "blockquote") or 1))
            want.append(text)
        page = "<nav><a href=/>n</a></nav><div class='ad'>ad</div><article>" + "".join(parts) + "</article><footer>&copy; f</footer>"
        assert H.main_text(page) == " ".join(want)


def test_long_and_odd_pages_take_linear_time():
    for page in ("<a " * 200_000, "<p>" * 50_000 + "x", "<div>" * 20_000, "<" * 300_000, '<p a="' * 20_000, "<article>" + "<p>word</p>" * 50_000):
        H.main_text(page)


def test_stored_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        want = " ".join(std.unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])).split())
        assert " ".join(got[r.page_id].text.split()) == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_rows(spark):
    rows = [(1, "u", None, "x"), (1, None, "<p>a</p>", "x"), (None, "u", "<p>a</p>", "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, got)) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)", "Row(page_id=1, url=None, text='a', n_chars=1)", "Row(page_id=None, url='u', text='a', n_chars=1)"])
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class=no-sidebar", "class='with-nav'", "id=nav-content", "class=widget", "id=sidebar", "class='page-footer banner'"])
def test_names_do_not_drop_the_article(wrapper):
    aside = "<div class=related><article>card</article></div><div id=site-footer>foot</div><div class='sidebar-left'>side</div>"
    assert H.main_text(f"<div {wrapper}><article><p>{PARA}</p></article></div>{aside}") == PARA
    assert H.main_text(f"<div {wrapper}><div class=ad>buy</div><main><p>{PARA}</p></main></div>{aside}") == PARA
    assert H.main_text(f"<div {wrapper}><p>{PARA}</p><p>{PARA}</p></div>{aside}") == f"{PARA} {PARA}"


def test_comments_and_cards_stay_out():
    assert H.main_text(f"<p>{PARA}</p><div class=related><article>card</article></div>") == PARA
    assert H.main_text(f"<article><p>{PARA}</p><div id=comments><p>{PARA}</p><p>{PARA}</p></div></article>") == PARA


@pytest.mark.parametrize(
    "para",
    [
        "Верховна Рада ухвалила закон про державний бюджет на наступний рік, повідомляє кореспондент агентства. За рішення проголосували двісті сорок депутатів, решта утрималися або не брали участі в голосуванні, додав спікер.",
        "Государственная дума приняла закон о бюджете на следующий год, сообщает корреспондент агентства. За решение проголосовали двести сорок депутатов, остальные воздержались или не участвовали в голосовании, добавил спикер.",
        "全国人民代表大会常务委员会今天在北京举行会议，审议了关于明年预算的报告。会议指出，今年以来经济运行总体平稳，居民收入持续增长，就业形势保持稳定，各项社会事业取得新的进展，人民生活水平不断提高，为明年的发展打下了坚实的基础。",
    ],
)
def test_other_languages_keep_their_paragraphs(para):
    links = "".join(f"<li><a href={i}>{para[:75]}</a></li>" for i in range(3))
    page = f"<ul>{links}</ul><h1>{para[:20]}</h1><p>{para}</p><p>{para[:100]}</p><p>{para}</p><ul>{links}</ul><p>©</p>"
    assert H.main_text(page) == f"{para[:20].strip()} {para} {para[:100].strip()} {para}"
    assert H.main_text(f"<h1>Heading</h1><p>{para[:100]}</p>") == f"Heading {para[:100].strip()}"


@pytest.mark.parametrize(
    "block,want",
    [
        ("<p><a href=r>The complete report of the commission on the matter</a> is out.</p>", "The complete report of the commission on the matter is out."),
        ("<div class=share-price>The price is 3.</div>", "The price is 3."),
        ("<p class=tags-list>Tags are words.</p>", "Tags are words."),
        ("<div id=menu>Soup of the day and fish.</div>", "Soup of the day and fish."),
        ("<p><a href=x>a" + "&nbsp;" * 60 + "</a> short link in a line of words</p>", "a short link in a line of words"),
        ("<div class=share><a href=f>Facebook</a> <a href=t>Mail it</a></div>", ""),
        ("<h3>More of it</h3><ul><li><a href=1>One other page</a></li><li><a href=2>Another page</a></li></ul>", ""),
        ("<div class=ad>A long advert with the usual words of the language in it, that is for the reader and not of the article at all, as you know it.</div>", ""),
    ],
)
def test_blocks_of_a_marked_article(block, want):
    assert H.main_text(f"<article><p>{PARA}</p>{block}<p>Short end.</p></article>") == " ".join(x for x in (PARA, want, "Short end.") if x)


def test_neighbours_against_brute_force():
    def brute(found, labels, marked):
        if "good" not in labels:
            labels = ["good" if x == "near!" else x for x in labels]
        out, decided = [], [i for i, x in enumerate(labels) if x in ("good", "bad")]
        for i, b in enumerate(found):
            before, after = [j for j in decided if j < i], [j for j in decided if j > i]
            edge = "good" if marked else "bad"
            a, z = labels[before[-1]] if before else edge, labels[after[0]] if after else edge
            if labels[i] in ("good", "bad"):
                out.append(labels[i])
            elif labels[i] != "open":
                out.append("good" if marked or "good" in (a, z) else "bad")
            elif b.heading:
                out.append(z if after else a)
            elif a == z:
                out.append(a)
            elif marked:
                out.append("good")
            else:
                da, dz = i - before[-1] if before else 10**6, after[0] - i if after else 10**6
                out.append("bad" if da == dz else a if da < dz else z)
        return out

    for n in range(6):
        for labels in itertools.product(["good", "near!", "near", "open", "bad"], repeat=n):
            for marked in (False, True):
                for k in range(n + 1 if n < 4 else 1):
                    found = [H.Block("x", 0, marked, i == k - 1) for i in range(n)]
                    assert H.pass_two(found, list(labels), marked) == brute(found, list(labels), marked)


def test_pages_without_article_marks(spark):
    """The stored pages without their article tags: both passes have to find the text."""
    kept = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = std.unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])).split()
        got = H.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")).split()
        total += len(want)
        kept += len(want) if got == want else sum((w in set(want)) for w in got)
        assert not set(re.findall(r"<li><a [^>]*>([^<]{9,})", r.html)) & set(got) - set(want)
    assert kept >= 0.9 * total


def test_unmatched_tags_take_linear_time():
    def took(make, n):
        began = time.perf_counter()
        H.main_text(make(n))
        return time.perf_counter() - began

    for make in (
        lambda n: "<div>" * n + "</ul>" * n, lambda n: "<b hidden><div>" + "<span hidden>" * n + "</b>" * n, lambda n: "<ul><li>" * n + "</p>" * n, lambda n: "<div><p>" * n + "</div>" * n,
        lambda n: "<div class=ad><p>x" * n, lambda n: "<section hidden>" * n + "</i></section>" * n,
    ):
        took(make, 2000)
        assert took(make, 40_000) < 40 * max(took(make, 4000), 0.01)
