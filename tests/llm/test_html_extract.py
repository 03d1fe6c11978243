"""HTML extraction: pages of several templates whose main text is known."""

import random

import pytest

from fathom.llm import html_extract as H

PAGE = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def pages(n=120):
    """(row, main text): four hosts with templates of their own; some pages
    have a very short article beside much longer chrome."""
    rng, out = random.Random(8), []
    for i in range(n):
        paras = [words(rng, rng.choice([1, 2, 40, 90])) for _ in range(rng.randrange(1, 5))]
        chrome = " ".join(f'<li><a href="/{k}">{words(rng, 3)}</a></li>' for k in range(rng.randrange(2, 30)))
        notice, head = words(rng, 60), words(rng, 4)
        body = "".join(f"<p>{p}</p>" for p in paras)
        kind = i % 4
        if kind == 0:
            html = (f"<!DOCTYPE html><html><head><title>{head}</title><style>p{{}}</style></head><body><header>{notice}</header><nav><ul>{chrome}</ul></nav>"
                    f"<article><header><h1>{head}</h1></header>{body}</article><aside>{notice}</aside><footer>{notice}</footer></body></html>")
        elif kind == 1:
            html = (f'<html><body><div id="page"><div class="top-menu">{chrome}</div><div class="post-{i} entry"><h1>{head}</h1>{body}'
                    f'<div class="comments"><p>{notice}</p></div></div><div class="sidebar">{notice}</div></div><script>var a = "</p><p>";</script>')
        elif kind == 2:
            html = (f"<html><body><table><tr><td>{chrome}<td class=main><h1>{head}</h1>" + "".join(f"<p>{p}" for p in paras)
                    + f'<form><p>{notice}</p><input></form></table><div role="contentinfo">{notice}</div>')
        else:
            html = f"<html><body><main><section><h2>{head}</h2>{body}</section></main><div class='cookie-notice'>{notice}</div><!-- {notice} --></body></html>"
        out.append(((i, f"https://h{kind}.example.org/p/{i}", html), "\n\n".join([head, *paras])))
    return out


@pytest.mark.parametrize("bound", [1 << 20, -1])
@pytest.mark.parametrize("share", [0.001, 0.3])
def test_templates(spark, monkeypatch, bound, share):
    monkeypatch.setattr(H, "HOT_SHARE", share)
    made = pages()
    df = spark.createDataFrame([(*r, "x", 1) for r, _ in made], PAGE + ", text string, _paths int").repartition(6)
    got = {r["page_id"]: r for r in H.extract(df, broadcast_bytes=bound).collect()}
    assert len(got) == len(made)
    for (i, url, _), want in made:
        assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (want, len(want), url)
    assert {r["path"] for i, r in got.items() if i % 4 == 1} == {"html/body/div/div.entry.post-#"}


def test_the_vote_finds_what_one_page_does_not(spark):
    """A page whose notice outweighs its article follows its host."""
    made = [(i, "http://a.example/", f"<body><div class='lead'><p>{'text ' * 50}</div><div class='box'><p>{'x ' * 5}</div>") for i in range(9)]
    made.append((9, "http://a.example/9", f"<body><div class='lead'><p>short</div><div class='box'><p>{'y ' * 500}</div>"))
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(made, PAGE)).collect()}
    assert got[9] == "short"


def one(html):
    return H.Page(html).main_text([])[0]


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain", "plain"), ("<p>a &amp b &lt;i&gt; &#233;&eacute;&nope;</p>", "a & b <i> éé&nope;"), ("<p>a\n\t b<br>c<b>d</b>e", "a b cde"),
    ("<p>1 < 2 <3", "1 < 2 <3"), ("<p>a<p b='", "a"), ("<p>a<!-- b", "a"), ("<p title=\"a>b\">c", "c"), ("<p class=x\">c", "c"),
    ("<script>a</script><p>b<style>c", "b"), ("<svg/><p>b", "b"), ("<div hidden>x</div><p>b</p>", "b"), ("<nav>a<p>b", ""), ("</div></p>a", "a"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\n\nb\n\nc"), ("<P>A</P><DIV CLASS=Ad>x</DIV>", "A"),
    ("<div class='content has-sidebar'><p>a</p></div>", "a"), ("<p>a</p>\xa0<p>b</p>", "a\n\nb"), ("<title>t</title><textarea>x</textarea>a", "a")])
def test_markup(html, text):
    assert one(html) == text


def test_hostile_pages_take_linear_time():
    for html in ("<div>" * 200_000 + "x", "<p>" + "<" * 200_000, "<p " + "\"a" * 200_000, "<svg>" * 200_000, "<li>" * 100_000, "</b>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000):
        one(html)


def test_nulls_repeats_empty_and_long(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 200_000 + "</article>"
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "http://x", None), (2, "no scheme", ""), (3, "http://x/", long), (4, "http://y", "<nav>m</nav>")]
    df = spark.createDataFrame(rows, PAGE)
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in H.extract(df).collect()), key=repr)
    want = "\n\n".join(["word & word"] * 200_000)
    assert got == sorted([(1, None, "a", 1), (1, None, "a", 1), (0, "http://x", "", 0), (2, "no scheme", "", 0), (3, "http://x/", want, len(want)), (4, "http://y", "", 0)], key=repr)
    assert H.extract(df.limit(0)).collect() == []


def test_articles_of_the_table(table):
    """The article's blocks of every page, by a plain reading of the markup."""
    import html
    import re

    for r in H.extract(table("pages")).join(table("pages").drop("url"), "page_id").collect():
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", r["html"], re.S).group(1))
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in want if b)
