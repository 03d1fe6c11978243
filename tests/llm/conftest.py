"""Shared fixtures: odd documents, and the tables of the smallest scale."""

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, n: int) -> str:
    """``n`` words that depend on ``seed``."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("etaoinshrdlu"[(x >> s) % 12] for s in (3, 7, 11, 15, 19)))
    return " ".join(out)


def odd_documents() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, copies, near copies, a
    very long text, hot and null sources, non-ASCII letters."""
    long = passage(1, 6000)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "Öl ÉTÉ x\u00a0y 3.14", "de", "b", 9),
            (None, "all rights RESERVED, all rights reserved", "en", "a", 5), (6, long, "en", "a", len(long)), (7, long + " end", "en", "a", 1),
            (9, "many words " * 200_000, "en", "c", 1), (8, "one", "fr", "b", 3), (8, "one", "fr", "b", 3), (8, "other words of the same id", "fr", "b", 3)]
    rows += [(100 + i, passage(2, 80), "en", "a", 1) for i in range(40)]
    rows += [(200 + i, passage(2, 80).replace(" ", "  ", i) + f" {passage(300 + i, 1)}", "en", "a", 1) for i in range(10)]
    rows += [(300 + i, passage(1000 + i, 5 + i), ("en", "de")[i % 2], "ab"[i % 2], 1) for i in range(40)]
    return rows


# Names of outputs and of the operators' own columns.
CLASHES = """rank rejected lang_pred n_words spans items keep component_id fingerprint _row_id _row _bad _all _kept _salt _host _of _line
    _lines _page _pages _total _id _text _part _items _spans _n_words _longest _longest_at _fp _key _n _b _range _buckets _shift _inside _path _html _votes
    _aside_score digest""".split()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names clash with outputs
    and with the operators' own names."""
    rows = [(*r, "x", *[7] * len(CLASHES)) for r in odd_documents()]
    return spark.createDataFrame(rows, DOCS + ", score string" + "".join(f", {c} int" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
