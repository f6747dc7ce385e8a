"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.search import upto
from terrane.session import BROADCAST_ROWS, ROWS_PER_TASK, Spread


def history(df: DataFrame, attribute: str, key: Column, known_from: Column, value: Column, order: list[Column] = ()) -> DataFrame:
    """A change history of one attribute: rows (key, known_from, rank, value). Changes without key, time or value are
    left out: the last known value stays in force. Of several changes at one time the last by ``order`` (ascending,
    NULLs first) holds; further ties take the greatest value, so the result never depends on the order of rows."""
    h = df.select(key.alias("key"), known_from.alias("known_from"), F.struct(*order, value).alias("rank"), value.alias("value"))
    h = h.where(F.col("key").isNotNull() & F.col("known_from").isNotNull() & F.col("value").isNotNull())
    return h.groupBy("key", "known_from").agg(F.max_by("value", "rank").alias("value")).withColumn("attribute", F.lit(attribute))


def as_of(events: DataFrame, key: str, at: str, histories: dict[str, DataFrame], rows_per_task: int = ROWS_PER_TASK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each event with the last value of every attribute known at or before its time; NULL where none was.

    Every attribute keeps its own history, of any type and rhythm; none is widened to the others' changes. Each is
    matched separately, and its match comes back as a column of its own (the attributes pivoted to one row again).
    A history counted small (at most ``broadcast_rows`` changes) is packed into one sorted array per key, which is
    broadcast and searched by halving, so that events are not shuffled at all. For larger histories events and changes
    are co-partitioned by key and merged in time order once; keys with more than ``rows_per_task`` events are spread
    over as many partitions as they need, to which only their histories are copied (by the event's hash: exact
    repeats of an event stay together). Nothing later than the event is ever seen: at equal times the change comes first.

    Events keep all their columns and their number, repeats included; one without key or time gets NULLs. The names
    of the attributes must not be columns of the events.
    """
    clash = set(histories) & set(events.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    out, large = events, {}
    for name, h in histories.items():
        per_key = h.groupBy("key").agg(F.count("*").alias("n"))
        total, longest = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).collect()[0]
        if total > broadcast_rows:
            large[name] = h
        else:
            out = _searched(out, key, at, name, h, int(longest))
    out = _merged(out, key, at, large, rows_per_task) if large else out
    return out.select(*(F.col(f"`{c}`") for c in events.columns), *histories)


def _searched(events: DataFrame, key: str, at: str, name: str, h: DataFrame, longest: int) -> DataFrame:
    """The match in a broadcast sorted array of at most ``longest`` changes per key."""
    packed = h.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("known_from").alias("t"), F.col("value").alias("v")))).alias("_h"))
    packed = packed.select(F.col("key").alias("_k"), "_h")
    j = events.join(F.broadcast(packed), F.col(f"`{key}`") == F.col("_k"), "left")
    return j.withColumn(name, F.get(F.col("_h"), upto(F.col("_h"), "t", F.col(f"`{at}`"), longest) - 1)["v"]).drop("_k", "_h")


def _merged(events: DataFrame, key: str, at: str, histories: dict[str, DataFrame], rows_per_task: int) -> DataFrame:
    """The matches from one sorted stream of events and changes per key, each attribute carrying its own last value."""
    parts = Spread(events, F.col(f"`{key}`"), rows_per_task)
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    kinds = {a: h.schema["value"].dataType for a, h in histories.items()}
    empty = {a: F.lit(None).cast(t) for a, t in kinds.items()}
    e = events.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{at}`").alias("_t"), F.lit(1).alias("_e"), row.alias("_row"), *(v.alias(a) for a, v in empty.items()))
    whole = e.schema["_row"].dataType
    changes = [
        parts.copied(
            h.select(F.col("key").alias("_k"), F.col("known_from").alias("_t"), F.lit(0).alias("_e"), F.lit(None).cast(whole).alias("_row"), *((F.col("value") if a == b else v).alias(b) for b, v in empty.items())),
            F.col("_k"),
        )
        for a, h in histories.items()
    ]
    w = Window.partitionBy("_k", "_salt").orderBy("_t", "_e").rowsBetween(Window.unboundedPreceding, 0)
    timed = parts.salted(e.where(F.col("_k").isNotNull() & F.col("_t").isNotNull()), F.col("_k"), F.col("_row"))
    keyed = reduce(DataFrame.unionByName, changes, timed)
    matched = keyed.select("_e", "_row", *(F.last(a, ignorenulls=True).over(w).alias(a) for a in kinds)).where("_e = 1")
    lost = e.where(F.col("_k").isNull() | F.col("_t").isNull()).select("_e", "_row", *kinds)
    return matched.unionByName(lost).select("_row.*", *kinds)
