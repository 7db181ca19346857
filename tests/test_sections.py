"""Sections, items and numbers of literal texts."""

from pyspark.sql import functions as F

from fieldloom.functions import sections


def cut(spark, text, lang="en"):
    return [tuple(r) for r in sections.sections(spark.createDataFrame([(text,)], "t string"), "t", lang).orderBy("nth").collect()]


def test_titles_bodies_and_what_is_redundant(spark):
    text = "AD 2 EDXX some real prose AD 2.3 Operational  hours: MON 0800 ad 2 20 Local aerodrome regulations 1. Nights 2.1 Inside AD 2.12 RWY"
    assert cut(spark, text) == [
        (0, None, "Further AIP information", "AD 2 EDXX some real prose", False), (1, "2.3", "Operational hours", "MON 0800", True),
        (2, "2.20", "Local aerodrome regulations", "1. Nights 2.1 Inside", False), (3, "2.12", "Runway physical characteristics", "RWY", False),
    ]
    assert cut(spark, "HDR 1 AD 2.99 x", "de") == [(1, "2.99", "Weitere AIP-Angaben", "x", False)]
    assert cut(spark, "AD 2.6 RETTUNGS- und FEUERLÖSCHDIENSTE - ja", "de") == [(1, "2.6", "Rettungs- und Feuerlöschdienste", "ja", False)]


def test_texts_without_marks_have_no_sections(spark):
    assert cut(spark, None) == cut(spark, "") == cut(spark, "XAD 2.3 and GRAD 2.4 here") == []


def test_items_and_phones(spark):
    texts = [
        ("1. Platz Ab 2.1 Nacht 1.5 NM 24 Stunden 14.000 Kg 3. Ende", ["1. Platz Ab", "2.1 Nacht 1.5 NM 24 Stunden 14.000 Kg", "3. Ende"], None),
        (None, [], None), ("  ", [], None), ("plain", ["plain"], None),
        ("AD 2.2 TELEFAX 08912345678 TEL: +49 (0) 89/12 34-5 AD 2.3 x", ["AD 2.2 TELEFAX 08912345678 TEL: +49 (0) 89/12 34-5 AD 2.3 x"], "+49 (0) 89/12 34-5"),
        ("AD 2.2 none AD 2.20 TEL 0891234567", ["AD 2.2 none AD 2.20 TEL 0891234567"], None), ("AD 2.2 TEL 1234567890123456", ["AD 2.2 TEL 1234567890123456"], None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "i int, t string")
    got = df.select("i", sections.items(F.col("t")).alias("x"), sections.phone(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r.x, r.p) for r in got] == [(x, p) for _, x, p in texts]
