"""URL filters as a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels reversed, each followed by a dot: ``blog.example.org`` -> ``org.example.blog.``. A
rule on a host and its subdomains is then the interval [key, key with its last dot raised by one), and intervals of rules
are nested or disjoint, never crossing. Keys of distinct hosts and starts of rules are sorted together; the last rule that
starts at or before a host carries its chain of enclosing rules, which is the stack of the sweep at that point, and the
members whose intervals end after the host are the active rules. Paths are compared against the active rules only.

Hosts are pre-aggregated, so a hot host is one row of the sweep. Sweeps run in as many lanes as there are shuffle
partitions: each lane has its share of the hosts and all starts of rules, so no top-level domain makes a lane hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import shuffle_partitions, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(lo, stack) per distinct rule host: stack holds the rules of that host and of every enclosing host.

    rules: host, path, verdict. Each host looks up its own ancestors by exact key (one row per label), so this is an
    equi-join; the chain's length is bounded by the labels of a host name times the rules of one host.
    """
    r = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    ).distinct()
    r = r.withColumn("lo", host_key(F.col("rule_host"))).withColumn("hi", F.expr("concat(substring(lo, 1, length(lo) - 1), '/')"))
    own = r.groupBy("lo").agg(F.collect_set(F.struct("rule_host", "rule_path", "verdict", "hi")).alias("own"))
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), r"\.", -1)
    up = own.select("lo", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("above"))
    return up.join(own.select(F.col("lo").alias("above"), "own"), "above").groupBy("lo").agg(F.flatten(F.collect_list("own")).alias("stack"))


def sweep(hosts: DataFrame, rules: DataFrame, lanes: int) -> DataFrame:
    """(host, active): the rules whose interval holds each host."""
    stacks = rule_stacks(rules)
    starts = stacks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    events = hosts.select(F.pmod(F.xxhash64("host"), F.lit(lanes)).cast("int").alias("lane"), host_key(F.col("host")).alias("at"), F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    events = events.unionByName(starts.select("lane", F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack"))
    upto = Window.partitionBy("lane").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("top", F.last("stack", ignorenulls=True).over(upto)).where("kind = 1")
    # of the stack at the last start, the rules whose intervals end after the host's key are still open
    return seen.select("host", F.filter("top", lambda x: F.col("at") < x["hi"]).alias("active"))


def url_filter(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (host followed by path; null if none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (characters of host
    and path together) wins; of equally long ones the longer host, then ``block``. Without a fitting rule the verdict is
    ``default``. Null urls and urls without ``://`` have an empty host and path. A host with an empty label (a trailing
    dot) is taken as written. Repeated rows are judged one by one; an empty table or rule set is fine.
    """
    spark = df.sparkSession
    pages = df.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    hosts = stage(sweep(pages.select("host").distinct(), rules, shuffle_partitions(spark)), "hosts")
    hosts = hosts.where(F.size("active") > 0)
    fits = F.filter(F.col("active"), lambda x: F.startswith(F.col("path"), x["rule_path"]))
    ranked = F.transform(fits, lambda x: F.struct((F.length(x["rule_host"]) + F.length(x["rule_path"])).alias("n"), F.length(x["rule_host"]).alias("h"), (x["verdict"] == "block").alias("b"), F.concat(x["rule_host"], x["rule_path"]).alias("rule"), x["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    out = pages.join(hosts, "host", "left").withColumn("best", best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_from(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) rows."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
