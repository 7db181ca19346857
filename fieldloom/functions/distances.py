"""Declared distances out of a section's flattened text: runways in order, each with the first row that states a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.common import let

#: Attribute marks that leak into texts, the numbers under a table's head, what names a runway, what a row states.
MARK = r"[A-Z][A-Z0-9_]*;[^\s;]+;\d+"
HEAD = r"\bRemarks\b.*?\b1\s+2\s+3\s+4\s+5\s+6\b"
RUNWAY = "^(0?[1-9]|[12][0-9]|3[0-6])([LRCG]?)$"
FIELDS = ("tora", "toda", "asda", "lda")
NOTHING = "NIL"


def _tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, MARK, " "), r"\bM\b", " ")
    after = rf"(?s)^.*?{HEAD}(.*)$"
    body = let(bare, lambda t: F.when(t.rlike(f"(?s){HEAD}"), F.regexp_extract(t, after, 1)).otherwise(t))
    return F.filter(F.split(body, r"\s+"), lambda w: w != "")


def _starts(tokens: Column) -> Column:
    """Indexes of tokens where a row begins: a runway and four values, none of which an earlier row has taken."""
    value = lambda i, k: F.coalesce(F.get(tokens, i + k).rlike(f"^({NOTHING}|[0-9]+)$"), F.lit(False))
    row = lambda i: F.get(tokens, i).rlike(RUNWAY) & value(i, 1) & value(i, 2) & value(i, 3) & value(i, 4)
    some = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), row)
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("taken"))
    take = lambda s, i: F.struct((i + 5).alias("free"), F.concat(s["taken"], F.array(i)).alias("taken"))
    return F.aggregate(some, none, lambda s, i: F.when(i >= s["free"], take(s, i)).otherwise(s), lambda s: s["taken"])


def declared(text: Column) -> Column:
    """array<struct<runway, tora, toda, asda, lda>>, runways with two digits; a distance that is NIL (or beyond 64 bits) is null.

    Rows without any number are passed over; of those of the same runway the first counts. Null text and text without rows: none.
    """

    def read(tokens: Column) -> Column:
        def row(i: Column) -> Column:
            name, side = (F.regexp_extract(F.get(tokens, i), RUNWAY, g) for g in (1, 2))
            number = lambda k: F.get(tokens, i + k + 1).try_cast("bigint")
            return F.struct(F.concat(F.lpad(name, 2, "0"), side).alias("runway"), *[number(k).alias(f) for k, f in enumerate(FIELDS)])

        return let(F.filter(F.transform(_starts(tokens), row), lambda r: F.coalesce(*[r[f] for f in FIELDS]).isNotNull()), firsts)

    def firsts(rows: Column) -> Column:
        return let(F.transform(rows, lambda r: r["runway"]), lambda names: F.filter(rows, lambda r, i: F.array_position(names, r["runway"]) == i + 1))

    return F.coalesce(let(_tokens(text), lambda t: F.when(F.size(t) > 0, let(t, read))), F.array().cast("array<struct<runway:string,tora:bigint,toda:bigint,asda:bigint,lda:bigint>>"))
