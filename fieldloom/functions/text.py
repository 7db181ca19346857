"""Text: names, links, slugs, fail-soft JSON and small parsers, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.common import known, let

#: How editions are named in links, and in which groups their year, month and day stand; the first that gives a real day wins.
EDITION_PATTERNS = (
    (r"(?i)(\d{4})-(\d{2})-(\d{2})-(?:NON-)?AIRAC", "ymd"),
    (r"(?i)AIRAC-(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"_(\d{4})_(\d{2})_(\d{2})[/\\]", "ymd"),
    (r"(?i)/lo/(\d{2})(\d{2})(\d{2})/", "ymd"),
    (r"/(\d{4})([A-Z]{3})(\d{2})/", "ymd"),
    (r"(?i)_wef_(\d{2})([a-z]{3})(\d{4})", "dmy"),
    (r"(?i)_EFF_(\d{2})([A-Z]{3})(\d{4})", "dmy"),
    (r"(?i)/(\d{2})-(\d{2})-(\d{2})-(?:NON-)?AIRAC", "ymd"),
    (r"/(\d{4})-(\d{2})-(\d{2})/", "ymd"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def edition_date(url: Column) -> Column:
    """Date of the edition that a link names, by the first shape that gives one; two-digit years are of this century."""
    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    found = []
    for pattern, order in EDITION_PATTERNS:
        part = {k: F.regexp_extract(url, pattern, i + 1) for i, k in enumerate(order)}
        year = F.when(F.length(part["y"]) == 2, F.concat(F.lit("20"), part["y"])).otherwise(part["y"])
        month = F.coalesce(F.try_element_at(named, F.lower(part["m"])), part["m"])
        found.append(F.try_to_date(F.concat_ws("-", year, month, part["d"]), "yyyy-MM-dd"))
    return F.coalesce(*found)


def slug(text: Column) -> Column:
    """Lower case, other signs than letters and digits become single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def record_slug(code: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(code)), F.lit("")), slug(title))


def is_pdf(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.regexp_extract(url, r"^([^?#]*)", 1))
    return F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unescaped(text: Column) -> Column:
    """The five named entities of markup and non-breaking space; the ampersand last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def links(html: Column) -> Column:
    """Targets of href attributes in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1))


def largest_image(html: Column) -> Column:
    """Bytes of the embedded PNG that decodes to most; broken ones are passed over."""
    all_ = F.transform(F.regexp_extract_all(html, F.lit(r"data:image/png;base64,([A-Za-z0-9+/=]+)"), 1), lambda x: F.try_to_binary(x, F.lit("base64")))
    return F.aggregate(all_, F.lit(None).cast("binary"), lambda best, x: F.when(F.coalesce(F.length(x), F.lit(0)) > F.coalesce(F.length(best), F.lit(0)), x).otherwise(best))


def truncated(text: Column, most: int = 4000, reach: int = 200) -> Column:
    """At most so many characters and an ellipsis: cut at the last space if that is among the last `reach` characters."""
    cut = F.substring(text, 1, most)
    space = F.lit(most) - F.locate(" ", F.reverse(cut))  # index of the last space, most if there is none
    trimmed = F.rtrim(F.when((F.locate(" ", cut) > 0) & (space > most - reach), F.substring(cut, F.lit(1), space)).otherwise(cut))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(trimmed, F.lit(" …")))


#: Titles that name a chart or a section, not a place.
CHART_NAMES = "(?i)^(VAC|IAC|ADC|AOC|APDC|GMC|PATC|SID|STAR|SMAC|PDC|LDG|TAXI|PARK|GROUND|OACI|VFR|IFR|AD|HEL)$"
SECTION_NAMES = r"(?i)charts?\s+related|aerodrome\s+data|aeronautical\s+data|koskevat\s+kartat|see\s+alerts|\bAD\s*[23]\.\d"


def place_name(title: Column, code: Column) -> Column:
    """A title without the code at its end."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))
    return F.when((c != "") & F.upper(t).endswith(F.upper(c)), F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(c)))).otherwise(t)


def bad_title(title: Column, code: Column) -> Column:
    """Titles whose name part is empty, a chart's designator or a section's heading."""
    n = place_name(title, code)
    return (n == "") | n.rlike(CHART_NAMES) | n.rlike(SECTION_NAMES)


def code_guards(code: Column) -> Column:
    """Three guards that differ on purpose: four letters, four letters or digits, two to four letters."""
    return F.struct(code.rlike("^[A-Z]{4}$").alias("ingest"), code.rlike("^[A-Z0-9]{4}$").alias("api"), code.rlike("^[A-Z]{2,4}$").alias("contact"))


def language_vote(text: Column, german: str, english: str, glyphs: str = "[äöüßÄÖÜ]") -> Column:
    """de if markers and umlauts of German are more than markers of English, else en; ties and no text are en."""
    count = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return F.when(count(german) + count(glyphs) > count(english), "de").otherwise("en")


def json_strings(text: Column, fields: tuple[str, ...]) -> Column:
    """Array of structs of string fields; [] for anything that isn't an array; elements with other types are left out.

    from_json would turn numbers to strings, so types are looked at in the parsed value.
    """
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    typed = F.transform(items, lambda v: F.struct(*[json_text(v, f"$.{f}").alias(f) for f in fields]))
    whole = F.filter(typed, lambda v: F.size(F.array_compact(F.array(*[v[f] for f in fields]))) == len(fields))
    return F.coalesce(whole, F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"))


def dimensions(text: Column) -> Column:
    """struct(length, width) of LxW; a part that isn't all digits is unknown."""
    p = F.split(F.coalesce(text, F.lit("")), "x")
    whole = lambda i: F.when(F.get(p, F.lit(i)).rlike("^[0-9]+$"), F.get(p, F.lit(i)).try_cast("int"))
    return F.struct(whole(0).alias("length"), whole(1).alias("width"))


def frequencies(text: Column) -> Column:
    """TYPE,MHZ;TYPE,MHZ as structs; pairs without a type or a frequency are left out and frequencies stay text."""
    pairs = F.transform(F.split(text, ";"), lambda x: F.split(x, ","))
    part = lambda p, i: F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit("")))
    return F.transform(F.filter(pairs, lambda p: (part(p, 0) != "") & (part(p, 1) != "")), lambda p: F.struct(part(p, 0).alias("type"), part(p, 1).alias("mhz")))


def first_known(arrays: list[Column]) -> Column:
    """The first array that isn't empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])



def json_text(doc: Column, path: str, most: int | None = None) -> Column:
    """A string field of parsed JSON (not a number's text), cut to `most` characters; null for any other type."""
    own = let(F.try_variant_get(doc, path, "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.substring(own, 1, most) if most else own


def json_number(doc: Column, path: str) -> Column:
    """A numeric field of parsed JSON; null for any other type."""
    number = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return let(F.try_variant_get(doc, path, "variant"), lambda v: F.when(number(v), F.try_variant_get(v, "$", "double")))


#: What a beacon may report, and from where on a value is absurd.
VITALS, ABSURD = ("LCP", "CLS", "INP", "FCP", "TTFB"), 3_600_000


def beacons(df: DataFrame, raw: str) -> DataFrame:
    """Page-view beacons as wide rows: paths of the own site only, known metrics with values that can be; rows with none of them drop out."""
    from fieldloom.functions.measures import round_up_half

    doc = F.try_parse_json(raw)
    out = df.withColumn("_doc", doc).withColumn("url", json_text(F.col("_doc"), "$.url", 256)).filter(F.col("url").startswith("/"))
    for m in VITALS:
        v = json_number(F.col("_doc"), f"$.metrics.{m}")
        out = out.withColumn(m.lower(), F.when((v >= 0) & (v < ABSURD), round_up_half(v, 3)))
    known = F.coalesce(*[F.col(m.lower()) for m in VITALS]).isNotNull()
    out = out.filter(known).withColumn("nav", F.nullif(json_text(F.col("_doc"), "$.nav", 32), F.lit(""))).withColumn("conn", F.nullif(json_text(F.col("_doc"), "$.conn", 16), F.lit("")))
    return out.drop("_doc", raw)


def client_errors(df: DataFrame, raw: str) -> DataFrame:
    """Error beacons: bounded texts, whole numbers from 0 on; rows without a message or a path of the own site drop out."""

    def read(doc: Column) -> Column:
        some = lambda path, most: F.nullif(json_text(doc, path, most), F.lit(""))
        whole = lambda path: let(json_number(doc, path), lambda n: F.when(n >= 0, F.floor(n)))
        kind = F.when(json_text(doc, "$.kind") == "unhandledrejection", "unhandledrejection").otherwise("error")

        def row(own: Column) -> Column:
            rest = [some("$.source", 256).alias("source"), some("$.stack", 4000).alias("stack"), whole("$.lineno").alias("lineno"), whole("$.colno").alias("colno")]
            return F.when(own["message"].isNotNull() & own["url"].startswith("/"), F.struct(kind.alias("kind"), own["message"].alias("message"), own["url"].alias("url"), *rest))

        return let(F.struct(some("$.message", 500).alias("message"), some("$.url", 256).alias("url")), row)

    rest = [c for c in df.columns if c != raw]
    return df.select(*rest, known(let(F.try_parse_json(raw), read)).alias("_x")).select(*rest, "_x.*")


#: Letters that no decomposition turns into plain ones.
PLAIN = (("Ð", "D"), ("ð", "d"), ("Þ", "TH"), ("þ", "th"), ("Æ", "AE"), ("æ", "ae"), ("Ø", "O"), ("ø", "o"), ("Å", "A"), ("å", "a"))


def folded(text: Column) -> Column:
    """Upper case without accents, for comparing a name with its transliteration; null stays null."""

    @F.pandas_udf("string")
    def bare(text: pd.Series) -> pd.Series:
        """Compatibility decomposition without combining marks. Spark has no function for it, so batches go through Arrow."""
        return text.str.normalize("NFKD").map(lambda t: "".join(c for c in t if not unicodedata.combining(c)), na_action="ignore")

    for sign, plain in PLAIN:
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return F.trim(F.upper(bare(text)))


def dsn(url: Column) -> Column:
    """struct<host, project, key, ingest> of https://<key>[:secret]@<host>/<project>; null unless all three are there.

    The project is the last part of the path; the host is in lower case, without the scheme's own port.
    """
    shape = r"^(?i)(https?)://([^:@/?#\s]+)(?::[^@/?#\s]*)?@([^@/?#\s]+)((?:/[^/?#\s]*)*?)/([^/?#\s]+)/*(?:[?#].*)?$"
    scheme, host = F.lower(F.regexp_extract(url, shape, 1)), F.lower(F.regexp_extract(url, shape, 3))
    bare = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    key, project = F.regexp_extract(url, shape, 2), F.regexp_extract(url, shape, 5)
    ingest = F.concat(scheme, F.lit("://"), bare, F.lit("/api/"), project, F.lit("/envelope/?sentry_key="), key, F.lit("&sentry_version=7"))
    return F.when(F.coalesce(url.rlike(shape), F.lit(False)), F.struct(bare.alias("host"), project.alias("project"), key.alias("key"), ingest.alias("ingest")))
