"""URL block and allow rules by expression expansion and digest lookup.

A rule is a host (with all its subdomains) and a path prefix. Every url is expanded into its host suffixes times its
path prefixes of the lengths that rules have; expressions meet rules by an equi-join on the first eight hex digits of
SHA-256, the full digest confirms, and the longest rule wins (of equally long ones that with the longer host, then
block before allow).

Only distinct urls are expanded, so a hot url costs one expansion, and its pages meet the verdict by a broadcast
(``join_hot``). The rule table is broadcast only if its measured
size is at most ``BROADCAST_RULES`` rows; a larger one is shuffled on the digest prefix.

Nulls: a null url, or one without ``://``, has empty host and path and fits no rule. Empty labels are kept as they are.
Rules with a null host or path, or an unknown verdict, are ignored. Repeated pages come out repeated; an empty page
table gives an empty result. Input columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import HOT_ROWS, join_hot

BROADCAST_RULES = 100_000
PREFIX = 8


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    mark = F.instr(u, "://")
    rest = F.when(mark > 0, F.substring(u, mark + 3, F.length(u))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return df.withColumn("path", F.substring(rest, F.length(host) + 1, F.length(rest))).withColumn(
        "host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page; ``rules`` has host, path and verdict (block or allow)."""
    keyed = rules.where("host is not null and path is not null and verdict in ('block', 'allow')").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), _digest(F.col("host"), F.col("path")).alias("r_digest")
    ).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX))
    lengths = sorted(r[0] for r in keyed.select(F.length("r_path")).distinct().collect())  # no more than a url has characters
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    pages = with_host_path(pages.select("page_id", F.col("url").cast("string").alias("url")))
    every = pages.groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = every.where("host <> '' or path <> ''").select("host", "path")
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = (
        urls.select("host", "path", F.explode(suffixes).alias("e_host"), fit.alias("fit"))
        .select("host", "path", "e_host", F.explode("fit").alias("n"))
        .select("host", "path", _digest(F.col("e_host"), F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("e_digest"))
        .withColumn("e_prefix", F.substring("e_digest", 1, PREFIX))
    )
    table = F.broadcast(keyed) if small else keyed
    hits = expressions.join(table, F.col("e_prefix") == F.col("r_prefix")).where("e_digest = r_digest")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"), "r_host", "r_path", "r_verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("w")).select("host", "path", F.concat("w.r_host", "w.r_path").alias("rule"), F.col("w.r_verdict").alias("judged"))
    judged = join_hot(pages.select("page_id", "host", "path"), best, ["host", "path"], every.where(F.col("n") > HOT_ROWS))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("judged", F.lit(default)).alias("verdict"))
