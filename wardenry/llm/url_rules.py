"""URL filtering: explicit host and path rules, and association rules mined from what those rules label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import frozen
from wardenry.session import broadcast_if_small

# (host, path, verdict); a list written by hand, at most this long. It is evaluated row by row.
Rule = tuple[str, str, str]
MOST_RULES = 1000
# An item set must cover this share of the labelled urls, and a rule must be right this often.
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (size, rule, verdict) of the longest rule that fits the host or a domain above it and starts the path; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")

    def one(rule_host: str, rule_path: str, verdict: str) -> Column:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        return F.when(fits, F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.array_max(F.array_compact(F.array(*(one(*r) for r in rules))))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """All parts of a url, sorted: the host and every domain above it, its labels, path segments, file kind, query names and pairs, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    count = F.size(labels)
    above = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, count), "."))))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(asked, "&"), lambda x: x != "")
    named = lambda name, parts: F.transform(parts, lambda x: F.concat(F.lit(f"{name}="), x))
    flags = [F.when(kind != "", F.concat(F.lit("kind="), F.lower(kind))), F.when(F.contains(url, F.lit("?")), F.lit("query")), F.when(F.contains(url, F.lit("#")), F.lit("fragment"))]
    none = F.array().cast("array<string>")
    parts = [F.coalesce(above, none), named("label", labels), named("dir", segments), named("ask", F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1)))), named("pair", pairs), F.array_compact(F.array(*flags))]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def frequent_tokens(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> list[tuple[str, str]]:
    """(token, class) of tokens of that share of all rows (tokens, verdict) or more, in the order of their bytes.

    A share of ``min_support`` bounds them by the tokens of a mean row over it. Tokens of the very same rows are one class, named by the
    first: no rule can part them, and they would only multiply the rules. They are told by their count and two order-free checksums of their rows.
    """
    rows = labelled.select(F.xxhash64("tokens", F.monotonically_increasing_id()).alias("row"), "tokens").select("row", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("xor"), F.sum(F.col("row").cast("decimal(20,0)")).alias("sum"))
    enough = held.where(F.col("n") >= max(1.0, min_support * labelled.count()))
    classes = enough.groupBy("n", "xor", "sum").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return sorted(((t, r["tokens"][0]) for r in classes.select("tokens").collect() for t in r["tokens"]), key=lambda pair: pair[0].encode())


def only(tokens: Column, kept: list[tuple[str, str]]) -> Column:
    """The classes of the tokens that a sorted list holds, found by binary search. A url is of a class with any of its tokens."""
    if not kept:
        return F.array().cast("array<string>")
    entries, classes = (F.array(*map(F.lit, column)) for column in zip(*kept))
    steps = F.array(*(F.lit(1 << n) for n in range(len(kept).bit_length() - 1, -1, -1)))

    def found(token: Column) -> Column:
        below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(entries, at + step - 1) <= token, step).otherwise(0))
        return F.when(F.get(entries, below - 1) == token, F.get(classes, below - 1))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens, found))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) that FP-growth finds in rows (tokens, verdict), pruned by support and confidence.

    The tokens are those of ``frequent_tokens``: rarer ones are in no frequent set.
    """
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    if labelled.isEmpty():
        return empty
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    to = F.col("consequent")[0]
    plain = ~F.exists("antecedent", lambda t: t.startswith("verdict="))
    return model.associationRules.where(to.startswith("verdict=") & plain).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(to, len("verdict=") + 1, 1 << 20).alias("verdict"), "confidence", "support"
    )


def apply_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, verdict) for token sets (set, tokens) that some rule is part of: the surest rule's, then the best supported, then the longest.

    An inverted index finds candidates: every rule is filed under one token, the one that the fewest rules have, and met by the sets
    with that token. The rules are broadcast after they are counted; beyond a bound they are joined by a shuffle.
    """
    filed = rules.withColumn("__rule", F.xxhash64("tokens", "verdict"))
    common = filed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    index = filed.select("*", F.explode("tokens").alias("token")).join(common, "token").groupBy("__rule").agg(
        F.min(F.struct("rows", "token"))["token"].alias("token"), F.first("tokens").alias("needs"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"),
    )
    met = sets.select("set", "tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(frozen(index, "rules")), "token")
    inside = met.where(F.size(F.array_except("needs", "tokens")) == 0)
    return inside.groupBy("set").agg(F.max(F.struct("confidence", "support", F.size("needs").alias("size"), "verdict"))["verdict"].alias("verdict"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every url: (``id_col``, ``host``, ``path``, ``rule``, ``verdict``), in DataFrame functions only.

    The longest explicit rule that fits decides. Urls with one are the labelled baskets for FP-growth; the other urls get the verdict
    of the surest mined rule among their tokens, or ``default`` where none applies. Null urls and urls without ``://`` have empty
    host and path and no tokens. Repeated rows are judged alike; an empty table gives no rows.
    """
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("__id"), F.coalesce(url, F.lit("")).alias("__url"), url_host(url).alias("__host"), url_path(url).alias("__path"))
    found = longest_rule(F.col("__host"), F.col("__path"), rules)
    every = cut.select("*", found.alias("__found"), url_tokens(F.col("__url"), F.col("__host"), F.col("__path")).alias("__all"))
    ruled = every.where("__found is not null").select(F.col("__all").alias("tokens"), F.col("__found.verdict").alias("verdict"))
    kept = frequent_tokens(ruled, min_support)
    rows = every.withColumn("tokens", only(F.col("__all"), kept)).drop("__all")
    labelled = rows.where("__found is not null").select("tokens", F.col("__found.verdict").alias("verdict"))
    mined = frozen(mine_rules(labelled, min_support, min_confidence), "rules")
    rows = rows.withColumn("__set", F.concat_ws("\1", "tokens"))
    sets = rows.groupBy(F.col("__set").alias("set"), "tokens").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    judged = apply_rules(sets, mined)
    return rows.join(judged.withColumnRenamed("verdict", "__mined"), F.col("__set") == F.col("set"), "left").select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__found.rule").alias("rule"), F.coalesce(F.col("__found.verdict"), "__mined", F.lit(default)).alias("verdict")
    )
