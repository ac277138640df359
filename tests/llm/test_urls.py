"""The temporal list join: intervals, most specific keys, and defined cases."""

from datetime import date

from taxatrend.llm.url_filter import filter_captures, validity


def day(n):
    return date(2024, 1, n)


def test_intervals(spark):
    rows = [("block", "A.com", "add", day(2)), ("block", "a.com", "add", day(2)), ("block", "a.com", "remove", day(5)), ("block", "a.com", "add", day(7)), ("block", "a.com", "add", day(9)),
            ("allow", "b.com", "add", day(3)), ("allow", "b.com", "remove", day(3)), ("block", None, "add", day(1)), ("block", "c.com", "odd", day(1)), ("block", "c.com", "add", None)]
    e = spark.createDataFrame(rows, "list string, key string, action string, day date")
    assert {tuple(r) for r in validity(e).collect()} == {("block", "a.com", day(2), day(5)), ("block", "a.com", day(7), day(9)), ("block", "a.com", day(9), None)}


def test_captures(spark):
    e = spark.createDataFrame([("block", "a.com", "add", day(2)), ("block", "a.com", "remove", day(5)), ("allow", "good.a.com", "add", day(3)), ("block", "bad.good.a.com", "add", day(1))], "list string, key string, action string, day date")
    rows = [
        (1, "http://a.com/x", day(1)), (2, "https://u:p@A.com:8080/x", day(2)), (3, "http://a.com", day(5)), (4, "http://good.a.com/?q", day(2)), (5, "http://good.a.com/", day(4)),
        (6, "http://bad.good.a.com", day(4)), (7, "http://nota.com", day(3)), (8, None, day(3)), (9, "", day(3)), (10, "http://a.com", None), (11, "no scheme", day(3)), (2, "https://u:p@A.com:8080/x", day(2)),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, fetch_day date, kept string, `verdict_host` int")
    got = [(r.page_id, r.host, r.blocked_by, r.allowed_by, r.kept) for r in filter_captures(df, e).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.com", None, None, True), (2, "a.com", "a.com", None, False), (2, "a.com", "a.com", None, False), (3, "a.com", None, None, True), (4, "good.a.com", "a.com", None, False),
        (5, "good.a.com", "a.com", "good.a.com", True), (6, "bad.good.a.com", "bad.good.a.com", "good.a.com", False), (7, "nota.com", None, None, True), (8, None, None, None, True),
        (9, None, None, None, True), (10, "a.com", None, None, True), (11, None, None, None, True),
    ], key=str)
    assert filter_captures(df, e).count() == 12 and filter_captures(df.filter("page_id > 20"), e).count() == 0 and filter_captures(df, e.limit(0)).filter("kept").count() == 12
