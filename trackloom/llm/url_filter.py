"""URL rules: a url is judged by the longest rule whose host and path it falls under.

Method: a url expands into those host suffixes whose number of labels some rule
has, times those path prefixes whose length some rule has; each expression joins
the rules on the first 32 bits of its SHA-256, matches are confirmed on the full
digest, and the longest rule wins (of equal rules, a block). DataFrame functions
only.

Rules are counted: up to ``broadcast_rules`` are broadcast; beyond that they are
shuffled on the hash prefix, and the expressions of a frequent prefix (all urls
below one host) are dealt over many tasks. Urls are judged once however often
they occur, and the rows of a frequent url are dealt over many tasks. Nulls and edge cases: a null url, or one without ``://``, has an
empty host and path and fits no rule; rules with a null or empty host fit
nothing; a rule's null path is empty; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.hotkeys import attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 100_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("prefix", F.substring("digest", 1, 8))


def _expressions(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """parts (url, host, path) with a row for each expression and its digest; sizes: one row, the label counts of rule hosts and the lengths of rule paths."""
    n_labels = F.char_length("host") - F.char_length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.filter("labels", lambda n: n <= n_labels), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    out = parts.where("host != ''").join(F.broadcast(sizes)).select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    out = out.where("suffix != ''").select("url", "suffix", F.explode("prefixes").alias("start"))
    return _digest(out.select("url", F.concat("suffix", F.lit("\n"), "start").alias("expression")), F.col("expression")).select("url", "prefix", "digest")


def _matches(expressions: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """Expressions with the rules of their digest: joined on its first 32 bits, confirmed on the whole."""
    if rules.count() <= most:
        return expressions.join(F.broadcast(rules), "prefix").where("digest = rule_digest")
    by_prefix = rules.groupBy("prefix").agg(F.collect_list(F.struct("rule_digest", "rule_host", "rule_path", "rule_verdict")).alias("found"))  # different rules share a prefix by chance alone
    found = attach(expressions, by_prefix, ["prefix"], ["url"]).select("url", "digest", F.explode("found").alias("found"))
    return found.select("url", "digest", "found.*").where("digest = rule_digest")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` joined with what is known of its url: url, host, path, rule, verdict (one row for each distinct url; null included).

    ``rules``: host, path (with its leading slash), verdict ("allow" or "block").
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host != ''")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # of equal rules, a block
    n_labels = F.size(F.split("rule_host", r"\."))
    sizes = rules.agg(F.collect_set(n_labels).alias("labels"), F.collect_set(F.char_length("rule_path")).alias("lengths"))  # as many as rules have different ones
    rules = _digest(rules, F.concat("rule_host", F.lit("\n"), "rule_path")).withColumnRenamed("digest", "rule_digest")
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    matches = _matches(_expressions(parts, sizes), rules, broadcast_rules)
    rule = F.concat("rule_host", "rule_path")
    best = matches.groupBy("url").agg(F.max(F.struct(F.char_length(rule).alias("size"), F.col("rule_verdict"), rule.alias("rule"))).alias("best"))
    found = parts.join(best, "url", "left")
    return found.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def with_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    judged = judge_urls(rows, rules, default=default, broadcast_rules=broadcast_rules).where("rule is not null").select("url", "rule", "verdict")
    out = attach(rows.where("url is not null"), judged, ["url"], ["page_id"], "left")
    out = out.unionByName(rows.where("url is null"), allowMissingColumns=True)
    return out.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
