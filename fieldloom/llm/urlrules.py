"""URL filters: written host rules first, mined association rules for the rest.

Written rules are (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's; the
longest that fits wins. URLs without one are judged by rules that FP-growth mines: each labelled page is a
transaction of its URL's tokens and of its label; rules `tokens => block` with enough support, certain confidence and lift stay. Tokens that
stand in the same labelled pages are one item, so a long URL on many pages is one item, not a power of two of itemsets. Rules
are matched by an inverted index from each rule's rarest token: a URL's tokens meet only the rules listed under them, and
the rule fits if its other tokens are there as well.

All of it is DataFrame and ML work inside the JVM. Matching works on distinct URLs with a mined rule only, so copies of a URL
are judged once.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed; repeated pages are
judged each; several labels of a page count as block if any does; without labels or without rules that pass, the method allows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded_broadcast
from fieldloom.session import materialise

#: verdict, host, path
WRITTEN = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Standard normal quantile of the certainty with which a rule's confidence has to be MIN_CONFIDENCE.
Z = 1.96
MIN_LIFT = 1.5
RULES_BROADCAST = 50_000
BLOCK = "=block"


def _rest(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def written_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = WRITTEN) -> Column:
    """struct(rule, verdict) of the longest written rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host and its parts, path segments, ending, query keys; none for a null URL."""
    some = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    host, path = host_of(url), path_of(url)
    return F.coalesce(
        F.array_distinct(
            F.concat(
                some("scheme:", F.array(F.lower(F.substring_index(url, "://", 1)))),
                some("site:", F.array(host)),
                some("host:", F.split(host, r"\.")),
                some("path:", F.split(path, "/")),
                some("end:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
                some("key:", F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)),
            )
        ),
        F.array().cast("array<string>"),
    )


def sure_share(hits: Column, n: Column) -> Column:
    """Wilson's lower bound (95 %) of a share of which hits of n were seen."""
    z2 = Z * Z
    return (hits + z2 / 2 - Z * F.sqrt(hits * (n - hits) / n + z2 / 4)) / (n + z2)


def merged_items(sets: DataFrame, least: int, n: int) -> DataFrame:
    """(item, members): tokens of `least` pages or more that stand in the same pages are one item; those of all n pages tell nothing.

    Without this, each of k tokens that come together would double the itemsets. Page sets are compared by their
    size and two sums of hashes; an item has no more members than one URL has tokens.
    """
    each = sets.select(F.explode("t").alias("token"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)).alias("x"), F.pmod(F.xxhash64(F.lit(1), "page_id", "url"), F.lit(1 << 40)).alias("y"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y")).filter((F.col("c") >= least) & (F.col("c") < n))
    return seen.groupBy("c", "x", "y").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """pages(page_id, url), labels(page_id, block) -> rules: rule (id), needs (tokens), key (rarest token), confidence, lift, support.

    Transactions are the distinct labelled (page_id, url). A rule stays if its block share is min_confidence or more with 95 % certainty
    (Wilson's lower bound), at least min_lift times that of all, and if it holds for min_support of all. No rule of fewer than
    z^2 c / (1 - c) pages can pass the first of these, so FP-growth need not look below.
    """
    spark = pages.sparkSession
    by_page = labels.groupBy("page_id").agg(F.max("block").alias("block"))
    sets = pages.select("page_id", "url").distinct().select("page_id", "url", tokens(F.col("url")).alias("t")).filter(F.size("t") > 0).join(by_page, "page_id")
    sets = materialise(sets, "url-sets")
    n = sets.count()
    empty = "rule string, needs array<string>, key string, confidence double, lift double, support double"
    if n == 0:
        return spark.createDataFrame([], empty)
    least = max(math.ceil(Z * Z * min_confidence / (1 - min_confidence)), math.ceil(min_support * n))
    items = materialise(merged_items(sets, least, n), "url-items")
    by_token = bounded_broadcast(items.select("item", F.explode("members").alias("token")), RULES_BROADCAST)
    some = sets.select("page_id", "url", F.explode("t").alias("token")).join(by_token, "token").groupBy("page_id", "url").agg(F.collect_set("item").alias("items"))
    both = sets.select("page_id", "url", "block").join(some, ["page_id", "url"])
    both = materialise(both.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "url-transactions")
    # support is of all labelled pages; those without a frequent item are in no itemset
    left = both.count()
    if left == 0:
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / left), minConfidence=min_confidence).fit(both)
    blocked = sets.filter("block").count()
    rules = model.associationRules.filter(F.element_at("consequent", 1) == BLOCK)
    hits = F.round(F.col("support") * left)
    rules = rules.withColumn("hits", hits).withColumn("pages", F.round(F.col("hits") / F.col("confidence"))).withColumn("lift", F.col("confidence") * n / max(1, blocked))
    rules = rules.filter((F.col("lift") >= min_lift) & (F.col("hits") >= min_support * n) & (sure_share(F.col("hits"), F.col("pages")) >= min_confidence))
    rules = rules.withColumn("id", F.array_join(F.array_sort("antecedent"), " "))
    # items back to their tokens; the rarest is the rule's key in the index
    parts = rules.select("id", F.explode("antecedent").alias("item")).join(items, "item").groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("needs"), F.min_by("item", F.struct("c", "item")).alias("key"))
    out = rules.join(parts, "id").withColumn("support", F.col("hits") / n)
    return materialise(out.select(F.array_join("needs", " ").alias("rule"), "needs", "key", "confidence", "lift", "support"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that fit a mined rule, with the most confident one."""
    index = bounded_broadcast(rules, RULES_BROADCAST)
    t = urls.select("url").distinct().withColumn("t", tokens(F.col("url")))
    hits = t.withColumn("key", F.explode("t")).join(index, "key").filter(F.size(F.array_except("needs", "t")) == 0)
    return hits.groupBy("url").agg(F.max_by("rule", F.struct("confidence", "support", "rule")).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = WRITTEN, **mining: float) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the mined rule that decided, else null)."""
    pages = pages.select("page_id", "url")
    found = mine(pages, labels, **mining)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.withColumn("host", host).withColumn("path", path).withColumn("w", written_rule(F.col("host"), F.col("path"), rules))
    open_urls = read.filter(F.col("w").isNull())
    out = read.join(matched(open_urls, found), "url", "left")
    decided = F.coalesce(F.col("w")["verdict"], F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("w")["rule"].alias("rule"), decided.alias("verdict"), F.when(F.col("w").isNull(), F.col("mined")).alias("mined"))
