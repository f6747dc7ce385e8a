"""Counts of filter steps, duplicate keys, rule failures, content digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def step_log(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, rows_before, rows_after, dropped) of cumulative filters, from one aggregate over one scan.

    A condition that is NULL drops the row. An empty table gives zeros.
    """
    kept, cond = [], F.lit(True)
    for _, c in steps:
        cond = cond & F.coalesce(c, F.lit(False))
        kept.append(F.count(F.when(cond, 1)))
    one = df.agg(F.count("*").alias("n0"), *(c.alias(f"n{i + 1}") for i, c in enumerate(kept)))
    rows = F.array(*(F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), C(f"n{i}").alias("rows_before"), C(f"n{i + 1}").alias("rows_after"), (C(f"n{i}") - C(f"n{i + 1}")).alias("dropped")) for i, (name, _) in enumerate(steps)))
    return one.select(F.inline(rows))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that more than one row has; NULL keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself; an error if a key repeats."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{keys} is not unique")
    return df


def assert_no_orphans(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left table; an error if a key of it has no partner."""
    if not left.join(right.select(*on).distinct(), on, "left_anti").isEmpty():
        raise ValueError(f"{on} without a partner")
    return left


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left table with the right one's columns, a left join; an error if a key repeats on either side."""
    return assert_unique(left, on).join(assert_unique(right, on), on, "left")


def failures(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``first_fail`` (NULL if all hold) and ``all_fails`` (joined by ';'); a rule that is NULL fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules)))
    return df.withColumn("_f", failed).withColumns({"first_fail": F.get("_f", F.lit(0)), "all_fails": F.array_join("_f", ";")}).drop("_f")


def errors(df: DataFrame, key: str, rules: list[tuple[str, Column]], unique: list[str] | None = None) -> DataFrame:
    """(key, error) for every rule that a row breaks, all of them; with ``unique``, also rows that share these
    columns with another row."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]
    if unique:
        df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*unique)))
        marks.append(F.when(C("_n") > 1, "duplicate"))
    return df.select(key, F.explode(F.array_compact(F.array(*marks))).alias("error"))


def content_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, digest) of a table without regard to the order of rows: the sum of the rows' 64-bit hashes. Repeats
    count; NULL differs from ''."""
    cols = columns or sorted(df.columns)
    strings = [F.coalesce(C(f"`{c}`").cast("string"), F.lit("\u0000")) for c in cols]
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*strings).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def audit(df: DataFrame, keys: list[Column], flags: dict[str, Column]) -> DataFrame:
    """Per key the number of rows and, for each flag, of those for which it is true."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(n) for n, c in flags.items()))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
