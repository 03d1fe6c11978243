"""Line dedup against counting in Python, on both ways of joining."""

from collections import Counter

from fathom.llm import line_dedup as D


def brute(rows, ratio, least):
    texts = {(r[3], r[1]) for r in rows if r[1] is not None}
    total, pages = Counter(host for host, _ in texts), Counter()
    for host, text in texts:
        pages.update({(host, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    bad = {k for k, n in pages.items() if n >= least and n > total[k[0]] * ratio}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
        else:
            lines = r[1].split("\n")
            kept = [x for x in lines if (r[3], x.strip(" ")) not in bad]
            out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ROWS = ([(i, f"menu\nline {i}\n\n  menu \nfoot{i % 3}", "en", "hot", 1) for i in range(30)]
        + [(100 + i, f"menu\ntail {i}", "en", None, 1) for i in range(6)]
        + [(200, "menu\nmenu\nonly", "en", "single", 1), (201, None, "en", "hot", 1), (202, "", "en", "hot", 0), (None, "menu", "en", "hot", 1), (203, "menu", "en", "hot", 1), (203, "menu", "en", "hot", 1)])


def test_like_brute_force_broadcast_and_joined(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "n_lines")
    for bound in (1 << 20, -1):
        got = D.drop_boilerplate(docs, ratio=0.3, min_pages=5, broadcast_bytes=bound)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_lines", "n_dropped"]
        assert sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_dropped")) for r in got.collect()), key=repr) == sorted(brute(ROWS, 0.3, 5), key=repr)


def test_odd_documents_keep_every_row(odd, none):
    assert D.drop_boilerplate(odd).count() == odd.count()
    assert D.drop_boilerplate(none).collect() == []


def test_copies_of_a_page_keep_their_lines(spark):
    rows = [(i, "the copied\npage", "en", "h", 1) for i in range(50)] + [(100 + i, f"menu\npage {i}", "en", "h", 1) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in D.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[0] == "the copied\npage" and got[100] == "page 0"


def test_the_footer_of_every_source_goes(spark):
    """The line that most pages share goes in every source, nothing else does."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    footers = D.boilerplate_lines(docs)
    n_sources = docs.select("source").distinct().count()
    assert (footers.count(), footers.select("_line").distinct().count(), footers.select("_host").distinct().count()) == (n_sources, 1, n_sources)


def test_any_column_names(odd, spark):
    for bound in (1 << 20, -1):
        out = D.drop_boilerplate(odd, broadcast_bytes=bound)
        assert out.select(odd.columns).drop("text").exceptAll(odd.drop("text")).count() == 0
        assert out.columns == [*odd.columns, "n_lines", "n_dropped"]


def test_no_python_in_the_plan(odd):
    plan = D.drop_boilerplate(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
