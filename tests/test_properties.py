"""Property tests: random values through the Spark expressions against the
plain-Python behaviour they reproduce. Each example is one batch, one job."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import dates, text
from fathom.operators import listing, manifest

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　"
texty = st.text(alphabet=st.sampled_from(list("ab-Q12 .:/?x" + WS)), max_size=12)


def _col(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")


def _eval(spark, values, expr):
    df = _col(spark, values).select("i", expr.alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


@SETTINGS
@given(st.lists(texty, min_size=40, max_size=40))
def test_strip(spark, values):
    assert _eval(spark, values, text.strip_ws(F.col("v"))) == [v.strip() for v in values]


def test_has_sql_cases(spark):
    cases = [("", False), ("  ", False), ("-- a", False), ("  -- a\n\t-- b", False), ("-- a\nSELECT 1", True), ("-x", True), ("\n\nselect", True),
             ("--;\r;", True), ("--\u2028x", True), ("\x1c--x\x1d;", True), ("\u3000-- x", False)]
    assert _eval(spark, [c[0] for c in cases], manifest.has_sql(F.col("v"))) == [c[1] for c in cases]


num_chars = st.sampled_from(list("0123456789.eE+- _xinfatyINF") + ["inf", "nan", "1e3", " "])


numbers = st.one_of(
    st.lists(num_chars, max_size=6).map("".join),
    st.integers(-2 ** 70, 2 ** 70).map(str),
    st.floats(allow_nan=False).map(repr),
    st.tuples(st.integers(1, 99), st.integers(290, 330)).map(lambda t: f"{t[0]}e{t[1]}"),
)


@SETTINGS
@given(st.lists(numbers, min_size=40, max_size=40))
def test_strict_number_like_pandas(spark, values):
    def pandas_ok(v):
        try:
            pd.to_numeric(pd.Series([v], dtype=object))
            return True
        except (ValueError, TypeError):
            return False

    def pandas_num(v):
        x = pd.to_numeric(pd.Series([v], dtype=object), errors="coerce")[0]
        return None if pd.isna(x) else float(x)

    assert _eval(spark, values, text.is_strict_number(F.col("v"))) == [pandas_ok(v) for v in values]
    got = _eval(spark, values, text.to_number(F.col("v")))
    want = [pandas_num(v) for v in values]
    # pandas parses integers past 64 bits only approximately; Spark rounds them exactly
    assert [g is None for g in got] == [w is None for w in want]
    assert all(g == w or abs(g - w) <= 1e-12 * abs(w) for g, w in zip(got, want) if g is not None)


LITERAL_DATASET_DATES = [
    ("", "—"), ("2024-01-05", "Jan 5, 2024"), (" 2023-12-31T08:30:00 ", "Dec 31, 2023"), ("2024-2-9", "Feb 9, 2024"),
    ("1999-07-04 23:59:59.5", "Jul 4, 1999"), ("2024-13-01", "2024-13-01"), ("2023-02-29", "2023-02-29"),
    ("2024-02-29Z", "Feb 29, 2024"), ("soon", "soon"), ("2024-00-10", "2024-00-10"), ("2024/01/05", "2024/01/05"),
]
LITERAL_MODEL_DATES = [
    ("", "—"), ("2024-01-05", "Jan 5, 2024"), ("2024-01-05T08:30:00Z", "Jan 5, 2024"), ("2024-01-05T08:30:00.123456789Z", "Jan 5, 2024"),
    ("2024-01-05 08:30:00", "Jan 5, 2024"), ("2024-01-05T08:30", "2024-01-05T08:30"), ("2024-01-05T24:00:00", "2024-01-05T24:00:00"),
    ("05.01.2024", "05.01.2024"), (" 2001-11-30 ", "Nov 30, 2001"),
]
LITERAL_RUN_DATES = [
    ("", "—"), ("2024-01-05T08:30:00Z", "Jan 5, 2024  08:30"), ("2024-01-05 23:05:09", "Jan 5, 2024  23:05"), ("2024-01-05", "Jan 5, 2024  00:00"),
    ("2024-01-05T08:30:00.5", "Jan 5, 2024  08:30"), ("2024-01-05T99:00:00", "Jan 5, 2024  00:00"), ("2024-01-32", "2024-01-32"), ("never", "never"),
]
LITERAL_SHARDS = [("Q1", "00/00/01/Q1"), ("q123456", "12/34/56/Q123456"), ("Q1234567", "12/34/56/Q1234567"), ("42", "00/00/42/42"), ("QQ7", "00/00/07/QQ7")]
LITERAL_TAGS = [("image:v1", "v1"), ("host:5000/image:v2", "v2"), ("image", ""), (":", ""), ("", ""), ("a:b:", "")]
LITERAL_QIDS = [("00/00/01/Q1.fdo.json", "Q1"), ("Q2.fdo.json", "Q2"), ("a/b/Q3", "Q3"), ("a/.fdo.json", ""), ("Q4.fdo.json.bak", "Q4.fdo.json.bak")]


def _literal(spark, cases, make):
    got = _eval(spark, [c[0] for c in cases], make(F.col("v")))
    assert got == [c[1] for c in cases]


def test_literal_dates(spark):
    now = "2024-02-01 00:00:00"
    _literal(spark, LITERAL_DATASET_DATES, lambda c: dates.fmt_dataset_date(c, now)[0])
    _literal(spark, LITERAL_MODEL_DATES, lambda c: dates.fmt_model_date(c, now)[0])
    _literal(spark, LITERAL_RUN_DATES, lambda c: dates.fmt_run_date(c, now)[0])


def test_literal_paths(spark):
    _literal(spark, LITERAL_SHARDS, listing.shard_path)
    _literal(spark, LITERAL_TAGS, listing.tag_after_colon)
    _literal(spark, LITERAL_QIDS, listing.qid_from_path)


day = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31))


@SETTINGS
@given(st.lists(st.tuples(day, st.times()), min_size=40, max_size=40))
def test_real_dates_keep_their_day_and_minute(spark, values):
    """A real timestamp, written out, shows the same month, day, year and minute."""
    now = "2024-02-01 00:00:00"
    written = [f"{d.isoformat()}T{t.strftime('%H:%M:%S')}" for d, t in values]
    shown = [f"{d.strftime('%b')} {d.day}, {d.year}" for d, _ in values]
    assert _eval(spark, written, dates.fmt_dataset_date(F.col("v"), now)[0]) == shown
    assert _eval(spark, written, dates.fmt_model_date(F.col("v"), now)[0]) == shown
    assert _eval(spark, written, dates.fmt_run_date(F.col("v"), now)[0]) == [f"{s}  {t.strftime('%H:%M')}" for s, (_, t) in zip(shown, values)]
