"""Hours out of texts: cases by hand for what each notation may say."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates, schedules

UNKNOWN, H24, CLOSED, NOTAM = ("unknown",), ("h24",), ("closed",), ("notam",)
SR, SS = "sr", "ss"


def plain(week):
    if week is None:
        return None
    bound = lambda b: b.m if b.t == "time" else b.t
    return [(d.kind,) if d.open is None else (d.kind, bound(d.open), bound(d.close)) for d in week]


def read(spark, rows, schema, column):
    return [plain(r[0]) for r in spark.createDataFrame(rows, schema).select(column).collect()]


def win(a, b):
    return ("window", a, b)


TEXTS = [
    ("H24", [H24] * 7),
    ("Available by NOTAM", [NOTAM] * 7),
    ("MON-FRI 0800-1700", [win(480, 1020)] * 5 + [UNKNOWN] * 2),
    ("mon – fri 0800-1700; SAT 0900-SS", [win(480, 1020)] * 5 + [win(540, SS), UNKNOWN]),
    ("DAILY 0600-2200", [win(360, 1320)] * 7),
    ("0700-1900", [win(420, 1140)] * 7),
    ("0000-2400", [win(0, 1440)] * 7),
    ("2200-0600", [win(1320, 360)] * 7),
    ("MON 800-1700", [UNKNOWN] * 7),
    ("MON 0860-1700; MON H24", [UNKNOWN] * 7),
    ("O/R", [UNKNOWN] * 7),
    ("SAT-MON SR-SS\nTUE CLSD", [win(SR, SS)] + [UNKNOWN] * 4 + [win(SR, SS)] * 2),
    ("SAT-MON SR-SS; TUE CLSD; DLY H24", [win(SR, SS), CLOSED, H24, H24, H24, win(SR, SS), win(SR, SS)]),
    ("NOTAM; MON 0800-0900", [win(480, 540)] + [UNKNOWN] * 6),
    ("no hours here", None),
    ("", None),
    (None, None),
]


def test_free_text(spark):
    got = read(spark, [(t,) for t, _ in TEXTS], "t string", schedules.text_week(F.col("t")))
    for (text, want), week in zip(TEXTS, got, strict=True):
        assert week == want, text


def test_operator_row(spark):
    pages = [
        ("AD 2.3 AD 2.4 x AD 2.3 OPERATIONAL HOURS 1 AD operator MON-FRI 0600-2200 2 Customs H24 3 x AD 2.4 more", [win(360, 1320)] * 5 + [UNKNOWN] * 2),
        ("ad 2.3 1 Operator 0700-1900 customs and immigration H24 AD 2.13 x", [win(420, 1140)] * 7),
        ("AD 2.3 1 Operator H24 AIS only AD 2.4", None),
        ("AD 2.3 1 Operator H24 2 Customs", None),
        (None, None),
    ]
    got = read(spark, [(t,) for t, _ in pages], "t string", schedules.page_week(F.col("t")))
    assert got == [w for _, w in pages]


def test_documents(spark):
    rows = [
        ('{"operatingHours":[{"dayOfWeek":0,"startTime":"08:00","endTime":"20:00:00"},{"dayOfWeek":0,"byNotam":true},{"dayOfWeek":5,"sunrise":true,"sunset":true},{"dayOfWeek":6,"byNotam":true}]}', [win(480, 1200), UNKNOWN, UNKNOWN, UNKNOWN, UNKNOWN, win(SR, SS), NOTAM]),
        ('{"operatingHours":[7,null,{"dayOfWeek":"1"},{"dayOfWeek":7},{"dayOfWeek":1.5},{"dayOfWeek":2,"startTime":800,"endTime":"2000"}]}', [UNKNOWN] * 7),
        ('{"operatingHours":[{"dayOfWeek":3,"startTime":"0800","endTime":"24:00","sunrise":"true"}]}', [UNKNOWN] * 7),
        ('{"operatingHours":[]}', None),
        ('{"operatingHours":{"dayOfWeek":1}}', None),
        ('{"remarks":"see AIP"}', None),
        ("[1]", None),
        ("{broken", None),
        (None, None),
    ]
    got = read(spark, [(t,) for t, _ in rows], "t string", schedules.document_week(F.col("t")))
    assert got == [w for _, w in rows]
    loose = read(spark, [(rows[2][0],)], "t string", schedules.document_week(F.col("t"), colon=False))
    assert loose == [[UNKNOWN] * 3 + [win(480, 1440)] + [UNKNOWN] * 3]


def test_notation(spark):
    rows = [
        ("24 / 7", None, [H24] * 7),
        ("Mo-Fr 08:00-18:00; Sa 9:00-13:00", 15.0, [win(420, 1020)] * 5 + [win(480, 720), UNKNOWN]),
        ("Mo-Fr 08:00-18:00", None, None),
        ('sunrise-sunset "by appointment"', None, [win(SR, SS)] * 7),
        ("Mo-Su 08:00-18:00; Su off", 0.0, [win(480, 1080)] * 6 + [CLOSED]),
        ("Mo-Su 08:00-18:00; Tu 22:00-02:00", 0.0, [win(480, 1080), win(1320, 120)] + [win(480, 1080)] * 5),
        ("Mo-Su 08:00-18:00; Tu 00:30-12:00", 30.0, [win(360, 960)] * 7),
        ("Mo-Su 08:00-18:00; PH off; Tu 25:00-26:00; Fr-Mo dawn-16:00", 0.0, [win(SR, 960), win(480, 1080), win(480, 1080), win(480, 1080), win(SR, 960), win(SR, 960), win(SR, 960)]),
        ("Mo - Fr 08:00-18:00", 0.0, None),
        ("Mo,We 24/7", 0.0, [H24, UNKNOWN, H24] + [UNKNOWN] * 4),
        ("Mo 08:00-12:00,13:00-17:00", 0.0, None),
        ('"only a comment"', 0.0, None),
        (None, 0.0, None),
    ]
    got = read(spark, [r[:2] for r in rows], "t string, lon double", schedules.notation_week(F.col("t"), F.col("lon")))
    for row, week in zip(rows, got, strict=True):
        assert week == row[2], row[0]


def test_specification(spark):
    rows = [(t,) for t in ("MON-FRI 0800-1700; SAT 0900-SS; SUN H24", "MON 0800-1700; WED 0800-1700; TUE 0000-2400", "SR-SS")]
    got = spark.createDataFrame(rows, "t string").select(schedules.specification(schedules.text_week(F.col("t"))).alias("s")).collect()
    told = [[(list(g.days), g.opens, g.closes) for g in r.s] for r in got]
    assert told == [[([0, 1, 2, 3, 4], "08:00", "17:00"), ([6], "00:00", "23:59")], [([0, 2], "08:00", "17:00"), ([1], "00:00", "24:00")], []]


@pytest.mark.parametrize(("minutes", "text"), [(0, "00:00"), (485, "08:05"), (1200, "20:00"), (1440, "24:00"), (1441, "00:00"), (-1, "24:00")])
def test_clock(spark, minutes, text):
    assert spark.range(1).select(dates.clock_of(F.lit(minutes))).first()[0] == text
