"""Declared distances: rows among other tokens, by hand."""

from pyspark.sql import functions as F

from fieldloom.functions import distances

HEAD = "DISTANCES RWY TORA (M) TODA (M) Remarks 1 2 3 4 5 6 "
CASES = [
    (HEAD + "08 860 870 880 890 NIL 26 860 860 860 860 NIL EHXX", {"08": (860, 870, 880, 890), "26": (860,) * 4}),
    (HEAD + "3 1064 1124 1199 1149 DTHR 50 M. 21 1149 1199 1199 1064 DTHR 135 M. 03G NIL NIL NIL NIL NIL", {"03": (1064, 1124, 1199, 1149), "21": (1149, 1199, 1199, 1064)}),
    (HEAD + "04 NIL NIL NIL 2020 NIL 04 1909 1969 1909 NIL from 27 3453 3513 3453 3453", {"04": (None, None, None, 2020), "27": (3453, 3513, 3453, 3453)}),
    (HEAD + "05 NIL NIL NIL NIL 05 1 2 3 4", {"05": (1, 2, 3, 4)}),
    ("x Remarks 1 2 3 4 5 6 16 T_D;TXT;484 1953 T_D;V;1 M 2152 T_D;V;2 M 1953 T_D;V;3 M 1954 T_D;V;4 M text 34L T_D;X;5 1 2 3 4", {"16": (1953, 2152, 1953, 1954), "34L": (1, 2, 3, 4)}),
    ("07 100 200 300 400 without a head", {"07": (100, 200, 300, 400)}),
    ("07 100 200 300 400 Remarks 1 2 3 4 5 6 09 1 2 3 4", {"09": (1, 2, 3, 4)}),
    ("08 09 10 11 12 13 14 15 16", {"08": (9, 10, 11, 12)}),
    ("37 NIL 00 NIL 08 1 2 3 x 40 NIL", {}),
    ("08 99999999999999999999 NIL NIL NIL 09 99999999999999999999 1 NIL NIL", {"09": (None, 1, None, None)}),
    ("", {}),
    (None, {}),
]


def test_cases(spark):
    out = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", distances.declared(F.col("t")).alias("d"))
    for r in out.collect():
        got = {x.runway: (x.tora, x.toda, x.asda, x.lda) for x in r.d}
        assert got == CASES[r.i][1], CASES[r.i][0]


def test_long_text(spark):
    text = " ".join(f"{n % 36 + 1:02d} {n} {n} NIL {n} remark" for n in range(3000))
    [r] = spark.createDataFrame([(text,)], "t string").select(distances.declared(F.col("t")).alias("d")).collect()
    assert [(x.runway, x.tora) for x in r.d] == [(f"{n % 36 + 1:02d}", n) for n in range(36)]
