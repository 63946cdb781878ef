"""URL filters: listed rules, and association rules for what they leave open.

Listed rules name a host with its subdomains and a start of the path; the longest that
fits decides. For other urls, FP-growth mines combinations of url tokens, of any length, that
go with the label "block" in labelled urls. Rules are pruned by support, confidence and lift, and a rule
that adds tokens to another one without being surer is dropped. Matching goes through
an inverted index: each rule is filed under one token, a url meets the rules of its own
tokens, and a rule fires if the url has all its tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import let, table, task_count, whole
from facetry.operators.lookup import attach, fits_broadcast
from facetry.session import stage

#: (host, start of the path, verdict) of the standing list.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    return let(F.instr(url, "://"), lambda at: F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. The list is configuration of the job."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for of, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: host labels by their place from the right, path parts, digits as a class, query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    at_host = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(4)).cast("string"), F.lit("="), x))
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    at_path = F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    return F.array_distinct(F.concat(at_host, at_path, F.transform(keys, lambda x: F.concat(F.lit("query="), x))))


#: The item that stands for the label; no token is empty.
BLOCKED = ""


def _items(each: DataFrame, least: int) -> DataFrame:
    """``token, item``: tokens in ``least`` blocked urls; tokens that always occur together are one item.

    Such tokens have the same urls, told by their number and a digest of them. FP-growth
    would list every subset of them, all with one count.
    """
    urls = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"u{i}") for i in range(2)]
    known = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("b").alias("b"), *urls).filter(F.col("b") >= least)
    known = stage(known, "tokens")
    classes = known.groupBy("n", "b", "u0", "u1").agg(F.min("token").alias("item"), F.count("*").alias("size"))
    found = stage(known.join(classes, ["n", "b", "u0", "u1"]).select("token", "item", "size"), "items")
    held = attach(each, found.filter("size > 1"), ["token"], "inner", spread_by="row").groupBy("row", "item", "size").agg(F.count("*").alias("held"))
    apart = held.filter("held < size").select("item").distinct()  # a digest that two sets of urls share by chance
    return stage(found.join(apart.withColumn("apart", F.lit(True)), "item", "left").select("token", F.when(F.col("apart"), F.col("token")).otherwise(F.col("item")).alias("item")), "items")


def _needed(sets: DataFrame) -> DataFrame:
    """The sure ones of ``set, confidence, sure`` that no sure subset matches in confidence; with a set, its subsets are there.

    Sets are taken by size: the most that subsets reach comes from the sets one item smaller.
    """
    kept, size, last = [], 1, None
    while True:
        level = sets.filter(F.size("set") == size)
        if last is None:
            level = level.withColumn("below", F.lit(0.0))
        else:
            without = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("set", lambda x, j: j != i))
            parts = level.select("set", F.explode(without).alias("less"))
            below = parts.join(last.select(F.col("set").alias("less"), "most"), "less").groupBy("set").agg(F.max("most").alias("below"))
            level = level.join(below, "set")
        own = F.when(F.col("sure"), F.col("confidence")).otherwise(0.0)
        last = stage(level.withColumn("most", F.greatest("below", own)), "rule-sets")
        if last.isEmpty():
            out = sets.limit(0)
            for level in kept:
                out = out.unionByName(level)
            return out.drop("sure")
        kept.append(last.filter(F.col("sure") & (F.col("confidence") > F.col("below"))).select(*sets.columns))
        size += 1


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.2) -> DataFrame:
    """Rules ``tokens, confidence, support`` from rows ``tokens array<string>, blocked boolean``.

    Baskets are all tokens of a url that are in enough blocked urls, and the label. The number of
    sets that FP-growth lists has no fixed bound: it is large where many tokens occur together
    nearly always, but not always.
    """
    spark = labelled.sparkSession
    blocked = F.coalesce(F.col("blocked"), F.lit(False)).cast("long")
    rows = labelled.filter(F.size("tokens") > 0).select("tokens", blocked.alias("b"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "labelled-urls")  # which fixes the numbers
    n = rows.agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    schema = "tokens array<string>, confidence double, support double"
    if not n["n"] or not n["b"]:
        return spark.createDataFrame([], schema)
    least = max(math.ceil(min_support * n["n"]), 1)
    each = rows.select("row", "b", F.explode(F.array_distinct("tokens")).alias("token"))
    items = _items(each, least)
    baskets = attach(each, items, ["token"], "inner", spread_by="row").groupBy("row").agg(F.collect_set("item").alias("items"), F.max("b").alias("b"))
    with_label = F.when(F.col("b") > 0, F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items"))
    baskets = stage(baskets.select(with_label.alias("items")), "baskets")
    count = baskets.count()
    if not count:
        return spark.createDataFrame([], schema)
    growth = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / count, numPartitions=task_count(spark))
    found = stage(growth.fit(baskets).freqItemsets, "frequent-sets")
    label = F.array_contains("items", BLOCKED)
    sets = found.filter(label & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCKED)).alias("set"), F.col("freq").alias("b"))
    sets = sets.join(found.filter(~label).select(F.array_sort("items").alias("set"), F.col("freq").alias("n")), "set")
    confidence = F.col("b") / F.col("n")
    sure = (confidence >= min_confidence) & (confidence / (n["b"] / n["n"]) >= min_lift)
    sets = stage(sets.select("set", confidence.alias("confidence"), (F.col("b") / n["n"]).alias("support"), sure.alias("sure")), "sets")
    rules = _needed(sets)
    # An item of several tokens stands for each of them.
    tokens = items.groupBy("item").agg(F.collect_list("token").alias("tokens"))
    parts = rules.select("*", F.explode("set").alias("item")).join(tokens, "item")
    parts = parts.groupBy("set", "confidence", "support").agg(F.collect_list("tokens").alias("choices"))
    grow = lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.concat(d, F.array(t)))))
    chosen = F.aggregate("choices", F.array(F.array().cast("array<string>")), grow)
    named = parts.select(F.explode(chosen).alias("tokens"), "confidence", "support")
    return stage(named.select(F.array_sort("tokens").alias("tokens"), "confidence", "support"), "rules")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, tokens`` and the surest rule that fires, for the rows (key, tokens array) where one does."""
    # A rule stands under its rarest token, as far as the rules tell: the one that fewest rules have.
    spread = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    filed = spread.join(often, "token").groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = filed.groupBy("token").agg(F.collect_list(F.struct(F.col("confidence").alias("confidence"), F.col("tokens").alias("rule"))).alias("rules"))
    meets = urls.select(key, "tokens", F.explode("tokens").alias("token"))
    small = fits_broadcast(rules)
    hits = meets.join(F.broadcast(index) if small else index, "token")
    fired = F.filter("rules", lambda r: F.size(F.array_except(r["rule"], F.col("tokens"))) == 0)
    best = hits.select(key, F.array_max(fired).alias("best")).filter("best IS NOT NULL")
    return best.groupBy(key).agg(F.max("best").alias("best")).select(key, F.col("best.rule").alias("fired"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, key: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """``key, url, host, path, rule, verdict, fired, confidence`` for every row.

    Labels are the verdicts of the list, a url that it leaves open counting as not blocked: so
    a combination has to be mostly blocked where it occurs to be blocked elsewhere. Each
    distinct url is judged once. A null url, or one without ``://``, has an empty host and path and is allowed, as is any
    url that no rule blocks. Repeated rows are judged alike; other columns are ignored.
    """
    rows = pages.select(F.col(key), F.col(url_col).cast("string").alias("url"))
    urls = rows.select(whole("url").alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    urls = urls.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    urls = stage(urls, "urls")
    labelled = urls.select("tokens", F.coalesce(F.col("listed.verdict") == "block", F.lit(False)).alias("blocked"))
    found = match(urls.filter("listed IS NULL").select("url", "tokens"), mine(labelled, **mining), "url")
    open_urls = found.withColumnRenamed("url", "_url")
    host, path = host_of(whole("url")), path_of(whole("url"))
    judged = rows.select(key, "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    judged = judged.join(open_urls, F.col("listed").isNull() & (F.col("url") == F.col("_url")), "left")
    verdict = F.coalesce("listed.verdict", F.when(F.col("fired").isNotNull(), "block").otherwise("allow"))
    return judged.select(key, "url", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "fired", "confidence")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page: the listed rule's, else that of the mined rules."""
    found = judge(table(spark, folder, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("fired", " ").alias("fired"), "confidence")
