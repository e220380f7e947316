import datetime

from pyspark.sql import functions as F

from belfry.functions import dates, text, times, urls



def day(value):
    return F.lit(value).cast("date")


def test_time_spellings(apply):
    cases = {"8:00 AM": 480, "5:30pm": 1050, "8:00 a.m.": 480, "8:00 A.M": 480, "8 p.m": 1200, "noon": 720, "Midnight": 0,
             "12:00 AM": 0, "12:15 pm": 735, "0830": 510, "2359": 1439, "17:45": 1065, " 7 AM ": 420,
             "8:75 AM": 555, "13:00 PM": 1500}
    assert apply(times.minutes_of_day, *cases) == list(cases.values())


def test_unreadable_times_are_null(apply):
    assert apply(times.minutes_of_day, "", "  ", None, "after school", "24:00", "2460", "8:5 AM", "8.30", "AM") == [None] * 9


def test_event_dates(apply):
    cases = {"2026-04-15": "2026-04-15", "April 15, 2026": "2026-04-15", "Apr 5, 2026": "2026-04-05", "apr  05,  2026": "2026-04-05",
             "4/5/2026": "2026-04-05", "04/05/26": "2026-04-05", "4/5/99": "1999-04-05", "4/5/68": "2068-04-05",
             "2026-02-31": None, "Sept 5, 2026": None, "2/30/2026": None, "soon": None, "": None, "0000-01-01": None}
    assert apply(dates.event_date, *cases) == list(cases.values())


def test_relaxed_dates(apply):
    # "8 March 2026": the month-day spelling is tried first and reads the 20 of the year as a day
    ref = "2026-03-10"
    cases = {"Sunday, March 8th, 2026": "2026-03-08", "8 March": "2026-03-08", "8 March 2026": "2026-03-20", "bulletin-2026-03-08.pdf": "2026-03-08",
             "3-8-26": "2026-03-08", "03.15.2026": "2026-03-15", "12/28": "2025-12-28", "Feb 31 2026 then March 3 2026": "2026-03-03",
             "99/99": None, "no date": None, "": None, "Feb 29": None, "sept 6": "2026-09-06"}
    found = apply(lambda c: dates.relaxed_date(c, day(ref)).cast("string"), *cases)
    assert found == list(cases.values())


def test_yearless_date_on_a_tie_takes_the_earlier(apply):
    ref = "2024-07-02"
    assert apply(lambda c: dates.relaxed_date(c, day(ref)).cast("string"), "1/1") == ["2024-01-01"]


def test_next_occurrence(apply):
    today = "2026-06-10"  # a Wednesday
    weekly = lambda c: dates.next_occurrence(F.lit("weekly"), c, F.lit(None), F.lit(570), F.lit(0), day(today))
    assert apply(weekly, "Wednesday", "TUESDAY", "Someday", None) == [
        "2026-06-10T09:30:00.000Z", "2026-06-16T09:30:00.000Z", None, None]
    dated = lambda c: dates.next_occurrence(F.lit("specific_date"), F.lit(None), c, F.lit(0), F.lit(0), day(today))
    assert apply(dated, "2026-06-10", "2026-06-09", "2027-02-31", "June") == [
        "2026-06-10T00:00:00.000Z", None, "2027-03-03T00:00:00.000Z", None]
    cancelled = lambda c: dates.next_occurrence(F.lit("weekly"), c, F.lit(None), F.lit(570), F.lit(1), day(today))
    assert apply(cancelled, "Wednesday") == [None]


def test_schedule_order(spark):
    rows = [(1, "weekly", "Saturday", None, 959), (2, "weekly", "Saturday", None, 960), (3, "weekly", "Sunday", None, 480),
            (4, "weekly", "Monday", None, 1380), (5, "weekly", "Tuesday", None, 360), (6, "specific_date", None, "2026-06-01", 600),
            (7, "specific_date", None, "2026-05-01", 700), (8, "weekly", None, None, 10), (9, "weekly", None, "2026-06-14", 30)]
    df = spark.createDataFrame(rows, "id int, kind string, day string, date string, start int")
    key = dates.schedule_key(F.col("kind"), F.col("day"), F.col("date"), F.col("start"))
    assert [r["id"] for r in df.orderBy(key, "id").collect()] == [9, 3, 2, 5, 4, 1, 8, 7, 6]


def test_display(apply):
    assert apply(dates.format_date, "2026-03-17", "2026-03-01", "2026-03-22", "2026-03-13") == [
        "Tuesday, March 17th", "Sunday, March 1st", "Sunday, March 22nd", "Friday, March 13th"]
    minutes = lambda c: times.format_time_lower(c.cast("int"))
    assert apply(minutes, "0", "480", "450", "720", "1439") == ["12 a.m.", "8 a.m.", "7:30 a.m.", "12 p.m.", "11:59 p.m."]
    assert apply(lambda c: times.format_time(c.cast("int")), "0", "725", "1380") == ["12:00 AM", "12:05 PM", "11:00 PM"]


def test_hhmm(apply):
    assert apply(lambda c: times.from_hhmm(c, 7), "0800", "2400", "2345", "2500", "0860", "8am", None) == [480, 1439, 1425, 7, 7, 7, 7]


def test_address(apply):
    parsed = apply(text.parse_address, "12 Main St, Ithaca, NY 14850-1234", "near the mill", "  ", None)
    assert parsed[0].asDict() == {"line1": "12 Main St", "line2": None, "city": "Ithaca", "state": "NY", "postal_code": "14850-1234"}
    assert parsed[1]["line1"] == "near the mill" and parsed[2]["line1"] is None and parsed[3]["line1"] is None
    assert apply(text.format_address, ("1 A St", "", "Town", "NY", None), (None, None, "", None, "1")) == ["1 A St, Town, NY", "1"]
    assert apply(text.address_key, ("1 A St", None, "Town", "", "1")) == ["1 A St||Town||1"]


def test_cache_version(apply):
    found = apply(text.cache_version, " v 1/2 ", "", None, "x" * 90)
    assert found[0].startswith("v_1_2-") and found[1] == found[2] and found[1].startswith("unknown-")
    assert len(found[3]) == 80 + 1 + 12


def test_resolve_url(apply):
    base = "http://a/b/c/d?q"
    cases = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
             "?y": "http://a/b/c/d?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d?q#s", "": base, "..": "http://a/b/",
             "../g": "http://a/b/g", "../../g": "http://a/g", "../../../g": "http://a/g", "mailto:x": "mailto:x", "g#s": "http://a/b/c/g#s"}
    assert apply(urls.resolve_url, *[(base, h) for h in cases]) == list(cases.values())


def test_provider_links(apply):
    e = lambda c: urls.ecatholic_url(F.lit("https://p.org/bulletins"), c)
    assert apply(e, "https://files.ecatholic.com/1/bulletins/a.pdf", "https://files.ecatholic.com/1/docs/a.pdf",
                 "https://x.org/bulletins/a.pdf") == ["https://files.ecatholic.com/1/bulletins/a.pdf", None, None]
    d = lambda c: urls.discover_url(F.lit("https://discovermass.com/church/x/"), c)
    good = "https://bulletins.discovermass.com/download.php?bulletin=7"
    assert apply(d, good, "https://bulletins.discovermass.com/download.php?bulletin=", "/download.php?bulletin=7") == [good, None, None]
    o = lambda c: urls.parishes_online_url(F.lit("https://parishesonline.com/organization/x"), c, F.lit("x"))
    link = "/publication-page/x?selectedPublication=https%253A%252F%252Fcontainer.parishesonline.com%252Fa%252Bb.pdf"
    hit, wrong = apply(o, link, link.replace("/x?", "/y?"))
    assert hit["fetch_url"] == "https://container.parishesonline.com/a+b.pdf" and wrong is None


def test_anchors_and_embedded_urls(apply):
    html = '<a class=x href="/a&amp;b"> <b>T</b> </a><a name=q>no</a><A HREF=\'z\'>Z</A>'
    assert [tuple(a) for a in apply(urls.anchors, html)[0]] == [("/a&b", "T"), ("z", "Z")]
    script = r'<script>{"u":"https:\/\/s.org\/f.pdf","v":"https://s.org/f.pdf"}</script>'
    assert apply(urls.html_pdf_urls, script) == [["https://s.org/f.pdf"]]


def test_provider_detection(apply):
    found = apply(urls.detect_provider, '<a href="https://parishesonline.com/find/St-Ann">', "https://FILES.ecatholic.com/x parishesonline", "none")
    assert [tuple(f) for f in found] == [("parishes_online", "St-Ann"), ("ecatholic", None), ("other", None)]


def test_strip_every_white_space(apply):
    assert apply(text.strip, " \t x \n") == ["x"]


def test_percent_encode(apply):
    assert apply(urls.percent_encode, "a b/c~(é)") == ["a%20b%2Fc~(%C3%A9)"]


def test_safe_date(apply):
    ymd = lambda y, m, d: dates.safe_date(y, m, d)
    assert apply(ymd, ("2024", "2", "29"), ("2023", "2", "29"), ("2023", "13", "1"), (None, "1", "1")) == [datetime.date(2024, 2, 29), None, None, None]
