"""URL filters (operator 9): host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_anew, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to
    ? # or the end. Null, or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def folder(path: Column) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with the key under which URLs find them: a short hash prefix and the full digest of host and folder."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    key = F.sha2(F.concat(host, F.lit("\n"), folder(F.col("path"))), 256)
    return rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        F.substring(key, 1, 8).alias("prefix"), key.alias("digest"), host.alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (url and any other columns) with host, path, rule and verdict.

    rules: host, path, verdict ("allow" or "block"); a rule fits its host and all subdomains if the URL's path starts
    with the rule's. Of several that fit, the longest (host and path together) wins; ties: the longer host, then
    block. No rule: rule is null and verdict the default. Rules with nulls or another verdict are ignored. Clashing
    columns of pages are replaced; null URLs have empty host and path. Only distinct (host, path) pairs are expanded,
    and no further than the deepest rule reaches, so long hosts or paths don't multiply rows.
    """
    found = prepared(rules)
    deepest = found.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.length(F.regexp_replace(folder(F.col("rule_path")), "[^/]", ""))), F.lit(0)).alias("folders"),
    ).first()
    host, path = split_url(F.col("url"))
    extra = [named(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    cut = pages.select(*extra, host.alias("host"), path.alias("path"))
    urls = cut.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest["labels"]))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    depth = F.least(F.length(F.regexp_replace(folder(F.col("path")), "[^/]", "")), F.lit(deepest["folders"]))
    folders = F.transform(F.sequence(F.lit(0), depth), lambda n: F.when(n == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/"))))
    expressions = urls.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    hashed = expressions.withColumn("full", F.sha2(F.concat("suffix", F.lit("\n"), "folder"), 256)).withColumn("prefix", F.substring("full", 1, 8))
    confirmed = hashed.join(found, "prefix").where((F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))
    told = fresh(cut, "best")[0]
    best = confirmed.groupBy("host", "path").agg(F.max(rank).alias(told))
    return join_anew(cut, best, ["host", "path"], "left").select(*extra, "host", "path", F.col(f"{told}.rule").alias("rule"), F.coalesce(f"{told}.verdict", F.lit(default)).alias("verdict"))
