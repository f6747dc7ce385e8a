"""References to records that do not exist (missing, deleted or arriving later)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import squash_key
from terrane.session import ROWS_PER_TASK, Spread


def reference_status(
    refs: DataFrame, parents: DataFrame, *, ref_key: Column, ref_period: Column, parent_key: Column, parent_from: Column, parent_to: Column,
    carry: dict[str, Column], spread: Column, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each reference with the state of the parent that it names.

    Parents are reduced to one row per key with its distinct validity intervals (months, so a bounded set). Both
    sides are then co-partitioned and sorted on (key, salt) and merged linearly: a sort-merge join, in which each
    reference meets its key's intervals once. Keys with more than ``rows_per_task`` references are spread over as many
    partitions as they need (by ``spread``) and only their parents are copied.

    Result: ``carry`` columns, ``ref_key``, ``ref_period``, ``status``:
    ``valid`` (an interval holds the period), ``missing`` (no such key), ``deleted`` (an interval ended before the
    period), ``late`` (all begin after it), ``undated`` (the reference has no period, or no interval has a begin),
    ``none`` (the key is NULL or blank). Keys are compared without case and white space. An end that is NULL or ''
    is open. Repeated rows on either side change nothing; each reference gives exactly one row.
    """
    r = refs.select(*(c.alias(n) for n, c in carry.items()), squash_key(ref_key).alias("ref_key"), ref_period.alias("ref_period"), F.xxhash64(spread).alias("_spread"))
    named = r.where(F.col("ref_key") != "")
    unnamed = r.where(F.coalesce(F.col("ref_key"), F.lit("")) == "").select(*carry, "ref_key", "ref_period", F.lit("none").alias("status"))
    parts = Spread(named, F.col("ref_key"), rows_per_task)
    p = (
        parents.select(squash_key(parent_key).alias("ref_key"), F.struct(parent_from.alias("a"), F.nullif(parent_to, F.lit("")).alias("b")).alias("spell"))
        .where(F.col("ref_key") != "")
        .groupBy("ref_key").agg(F.array_sort(F.collect_set("spell")).alias("spells"))
    )
    met = parts.salted(named, F.col("ref_key"), F.col("_spread")).join(parts.copied(p, F.col("ref_key")).hint("merge"), ["ref_key", "_salt"], "left")
    at = F.col("ref_period")
    holds = F.exists("spells", lambda s: (s["a"] <= at) & (s["b"].isNull() | (at <= s["b"])))
    ended = F.exists("spells", lambda s: (s["b"] < at) & s["a"].isNotNull())
    later = F.exists("spells", lambda s: s["a"] > at)
    status = (
        F.when(F.col("spells").isNull(), "missing").when(at.isNull(), "undated").when(F.coalesce(holds, F.lit(False)), "valid")
        .when(F.coalesce(ended, F.lit(False)), "deleted").when(F.coalesce(later, F.lit(False)), "late").otherwise("undated")
    )
    return met.select(*carry, "ref_key", "ref_period", status.alias("status")).unionByName(unnamed)


def orphans(status: DataFrame) -> DataFrame:
    """The references without a valid parent."""
    return status.where(F.col("status").isin("missing", "deleted", "late", "undated"))


def orphan_report(status: DataFrame, table: str, period: Column) -> DataFrame:
    """Number of orphans per table, period and status; pre-aggregated before its shuffle."""
    return orphans(status).groupBy(F.lit(table).alias("table_name"), period.alias("period"), "status").agg(F.count("*").alias("n_refs"))
