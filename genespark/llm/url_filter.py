"""URL filters: nested prefix rules as intervals over reversed hosts, matched by a sorted sweep (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one host are dealt into so many sweeps; each gets all rules of that host.
SALTS = 64


def url_host(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, in small letters; empty if there is no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _parents(host: Column) -> Column:
    """The host and all its parent domains, reversed: com, com.example, ..."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key), rules before urls: the stack holds the rules whose interval is open at the key."""
    stack, part = [], None
    for f in frames:
        out = []
        for uid, here, key, rule, verdict, page_id, host, path in f.itertuples(index=False, name=None):
            if here != part:
                stack, part = [], here
            while stack and not key.startswith(stack[-1][0]):  # past the end of the innermost interval
                stack.pop()
            if uid is None or pd.isna(uid):
                stack.append((key, rule, verdict))
            else:
                _, rule, verdict = stack[-1] if stack else (None, None, None)
                out.append((uid, None if pd.isna(page_id) else int(page_id), host, path, rule, verdict))
        frame = pd.DataFrame(out, columns=["uid", "page_id", "host", "path", "rule", "verdict"])
        yield frame.astype({"page_id": "Int64", "uid": "int64"})


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    rules: host, path, verdict; a rule fits its host and the hosts below it if the url's path starts with its path. Of
    the rules that fit, the longest (host and path together) decides; of equal rules that differ in their verdict,
    `block` does. Without a rule the verdict is `otherwise`. A null url, or one without ://, has an empty host and path.
    Rules with a null are left out. Every row stands for itself, repeated ones too.

    A rule is the interval of the keys that start with its reversed host, a blank and its path. A url has one key for
    each parent domain, at which it can only meet rules of that domain; so a partition holds one domain, or one share of
    a large one together with the rules of that domain, and the sweep needs memory for the open intervals alone.
    """
    url = F.col("url").cast("string")
    urls = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long"), url_host(url).alias("host"), url_path(url).alias("path")
    )
    keyed = urls.select("*", F.explode(_parents(F.col("host"))).alias("domain")).select(
        "uid",
        F.concat_ws(" ", "domain", F.pmod(F.xxhash64("uid"), F.lit(salts))).alias("part"),
        F.concat("domain", F.lit(" "), "path").alias("key"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
        "page_id", "host", "path",
    )
    given = rules.select(F.translate("host", _CAPITALS, _SMALL).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    given = given.filter("h is not null and p is not null and v is not null").groupBy("h", "p").agg(F.max_by("v", F.col("v") == "block").alias("v"))
    domain = reversed_host(F.col("h"))
    dealt = given.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).select(
        F.lit(None).cast("long").alias("uid"),
        F.concat_ws(" ", domain, "salt").alias("part"),
        F.concat(domain, F.lit(" "), "p").alias("key"),
        F.concat("h", "p").alias("rule"),
        F.col("v").alias("verdict"),
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
    )
    rows = keyed.unionByName(dealt).repartition("part").sortWithinPartitions("part", "key", F.col("uid").asc_nulls_first())
    met = rows.mapInPandas(_sweep, "uid long, page_id long, host string, path string, rule string, verdict string")
    best = met.groupBy("uid").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("x"),
    )
    return best.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", F.lit(otherwise)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The rows of pages whose host and path are not blocked, with all their columns."""
    blocked = judge(pages.select("page_id", "url"), rules, **options).filter("verdict = 'block'").select("host", "path").distinct()
    url = F.col("url").cast("string")
    return pages.join(blocked.select(F.col("host").alias("h"), F.col("path").alias("p")), (url_host(url) == F.col("h")) & (url_path(url) == F.col("p")), "left_anti")
