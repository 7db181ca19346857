"""Files of others with broken rows, guarded commits, and items of literal JSON."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import community
from fieldloom.operators import commits
from fieldloom.sources import files


def test_rows_keep_types_names_and_what_is_bad(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ident,elevation_ft,name\nLSZH,1416,"Zurich, ""Kloten"""\nLSGG,high,Geneva\nLSZB\n,,\n')
    rows = files.csv_rows(spark, str(tmp_path / "a.csv"), {"ident": "string", "elevation_ft": "int", "name": "string", "home_link": "string"})
    got = rows.orderBy("_order").select("ident", "elevation_ft", "name", "home_link", "_bad").collect()
    assert [tuple(r) for r in got] == [("LSZH", 1416, 'Zurich, "Kloten"', None, None), ("LSGG", None, "Geneva", None, None), ("LSZB", None, None, None, "LSZB"), (None, None, None, None, None)]


def test_first_in_the_files_wins(spark, tmp_path):
    head = "ident,icao_code,iso_country,type,name\n"
    (tmp_path / "1.csv").write_text(head + "LSZX, lszh ,ch,small_airport,\nCH-1,LSZ1,CH,small_airport,No code\n")
    (tmp_path / "2.csv").write_text(head + "LSZH,,CH,large_airport,Zurich\nLSGG,,CH,closed,Geneva\nLSZB,,CH,large_airport,Bern\n")
    got = files.aerodromes(files.csv_rows(spark, str(tmp_path), dict.fromkeys(head.strip().split(","), "string")), "CH", ("small_airport", "large_airport"), "u")
    assert sorted(tuple(r) for r in got.collect()) == [("CH", "LSZB", "Bern LSZB", "u", "vfr"), ("CH", "LSZH", "LSZH", "u", "vfr")]


def test_json_lines_that_break_are_kept_apart(spark, tmp_path):
    (tmp_path / "o").write_text('{"rawOb":"METAR","wdir":90,"visib":"6+","altim":1013.5,"temp":"7","clouds":[{"cover":"FEW","base":30}, 3]}\n\n{"rawOb":\n[]\n')
    rows = files.json_rows(spark, str(tmp_path / "o"))
    assert [r._bad for r in rows.filter("_bad is not null").collect()] == ['{"rawOb":']
    (o,) = files.observations(rows).collect()
    assert (o.raw, o.wdir, o.visib, o.altim, o.temp, [tuple(c) for c in o.clouds]) == ("METAR", "90", "6+", 1014, None, [("FEW", 30.0), (None, None)])


def batch(spark, **counts):
    return spark.createDataFrame([(g, i) for g, n in counts.items() for i in range(n)], "g string, i int")


@pytest.fixture
def store(spark, tmp_path):
    return str(tmp_path / "table"), str(tmp_path / "state")


def seen(spark, store):
    n = lambda df: {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    return n(spark.read.schema("i int, g string").parquet(store[0])), {r.g: r.n for r in commits.baseline(spark, store[1], "g").collect()}


def test_a_blocked_group_leaves_table_and_baseline(spark, store):
    assert {r.verdict for r in commits.commit(batch(spark, a=10, b=10, c=10), *store, "g").collect()} == {"pass"}
    got = {r.g: r.verdict for r in commits.commit(batch(spark, a=4, b=8, d=1), *store, "g").collect()}
    assert got == {"a": "block", "b": "warn", "d": "pass"}
    assert seen(spark, store) == ({"a": 10, "b": 8, "c": 10, "d": 1},) * 2
    assert commits.commit(batch(spark), *store, "g").count() == 0
    assert seen(spark, store) == ({"a": 10, "b": 8, "c": 10, "d": 1},) * 2


def test_a_baseline_that_broke_off_is_not_taken(spark, store):
    commits.commit(batch(spark, a=10), *store, "g")
    lost = Path(store[1]) / "v=2"
    lost.mkdir()
    (lost / "part-0.parquet").write_bytes(b"half")
    assert seen(spark, store)[1] == {"a": 10}
    commits.commit(batch(spark, a=9), *store, "g")
    assert seen(spark, store) == ({"a": 9}, {"a": 9})


def test_items(spark):
    item = (
        '{"geometry":{"coordinates":[9.5,47.25]},"elevation":{"value":100,"unit":0},"ppr":true,"type":2,"services":{"fuelTypes":[1,99,"3"],"passengerFacilities":[5]},'
        '"runways":[{"designator":"06","dimension":{"length":{"value":800,"unit":0},"width":{"value":60,"unit":1}},"surface":{"mainComposite":2},"turnDirection":1},{"designator":""}],'
        '"frequencies":[{"value":"118.5","type":14},{"value":118.5},{"value":"121.5","name":"EMG","type":0}]}'
    )
    df = spark.createDataFrame([(0, item), (1, "[1]"), (2, "{}"), (3, None)], "i int, doc string").withColumn("doc", community.json_object(F.col("doc")))
    one, *others = community.facts(df, "doc").orderBy("i").collect()
    assert (one.lat, one.lon, one.elevation_ft, one.ppr, one.fuel, one.restaurant, one.customs, one.aerodrome_type) == (47.25, 9.5, 328, True, ["AVGAS"], True, False, 2.0)
    assert [tuple(r) for r in one.runways] == [("06", 2625, 60, "Grass", "left")]
    assert [tuple(f) for f in one.frequencies] == [("Tower", None, "118.5"), ("EMG", "EMG", "121.5")]
    assert all(tuple(r)[1:] == (None, None, None, None, [], None, None, None, [], []) for r in others)
