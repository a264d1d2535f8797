"""Temporal URL filter: dated list entries become validity intervals that captures meet as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SALTS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port or trailing dot; null where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"[.]?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (domain, category, valid_from, valid_to) from dated events (domain, category, action, listed_at).

    ``add`` opens an entry of (domain, category) and the next ``remove`` closes it; an add while open or a
    remove while closed changes nothing. Of events of one key at one time a remove holds. valid_to is exclusive and
    null while open. Events with a null field or another action are ignored.
    """
    clean = entries.select(F.lower("domain").alias("domain"), "category", "action", "listed_at").where("domain is not null and category is not null and listed_at is not null and action in ('add', 'remove')")
    key = ["domain", "category"]
    state = clean.groupBy(*key, "listed_at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    w = Window.partitionBy(*key).orderBy("listed_at")
    turns = state.withColumn("before", F.lag("off").over(w)).where("off <> coalesce(before, 1)")
    spans = turns.withColumn("valid_to", F.lead("listed_at").over(w)).where("off = 0")
    return spans.select(*key, F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, url, fetch time, host, blocked, category and matched_domain.

    A capture is blocked if at its fetch time an entry of its host or of a parent domain is active; the longest such
    domain names the category, then the smallest category. A null URL, host or time matches nothing.
    Repeated captures keep a row each; an empty list blocks nothing.

    Hosts are reduced to distinct values before they meet the list, so a host with a third of all captures costs one row
    there. Intervals of one host are then spread over ``SALTS`` copies to meet its captures in as many tasks.
    """
    caps = captures.select(F.col(id_col), F.col(url_col), F.col(time_col), host_of(F.col(url_col)).alias("host"))
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = caps.where("host is not null").select("host").distinct().select("host", F.explode(suffixes).alias("domain"))
    spans = hosts.join(validity(entries), "domain").groupBy("host").agg(F.collect_list(F.struct("valid_from", "valid_to", (-F.length("domain")).alias("rank"), "category", "domain")).alias("spans"))
    salted = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = caps.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), F.col(url_col), F.col(time_col)), F.lit(SALTS)).cast("int"))
    active = F.filter("spans", lambda s: (s.valid_from <= F.col(time_col)) & (s.valid_to.isNull() | (F.col(time_col) < s.valid_to)))
    best = F.array_min(F.transform(active, lambda s: F.struct(s["rank"].alias("rank"), s.category.alias("category"), s.domain.alias("domain"))))
    return rows.join(salted, ["host", "__salt"], "left").withColumn("__best", best).select(
        id_col, url_col, time_col, "host", F.col("__best").isNotNull().alias("blocked"), F.col("__best.category").alias("category"), F.col("__best.domain").alias("matched_domain")
    )
