"""Session construction and the few settings that the engine reads from a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task takes; a key with more is spread over several.
ROWS_PER_TASK = 1_000_000
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def local_session(app: str = "terrane", cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller's own session is used as it is."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset a folder of this machine serves local
    sessions; on a cluster it would not reach the executors, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors cost one re-read and plans stay short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if counted to be small; else as it is, and the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


class Spread:
    """Heavy keys of a table spread over several partitions, as many as their rows need.

    Keys are counted once, pre-aggregated; a key with more than ``rows`` rows gets one part for each so many. There
    are at most (all rows / ``rows``) heavy keys; up to ``BROADCAST_ROWS`` of them travel as a broadcast table, beyond
    that by a join. Tables without a heavy key take no join at all. NULL keys are never heavy.
    """

    def __init__(self, df: DataFrame, key: Column, rows: int = ROWS_PER_TASK):
        counts = df.select(key.alias("_key")).where("_key is not null").groupBy("_key").agg(F.count("*").alias("n"))
        heavy = counts.where(F.col("n") > rows).select("_key", F.ceil(F.col("n") / rows).cast("int").alias("_parts"))
        first = heavy.limit(BROADCAST_ROWS + 1).collect()
        self.any = bool(first)
        self.table = heavy if len(first) > BROADCAST_ROWS else F.broadcast(df.sparkSession.createDataFrame(first, heavy.schema)) if first else heavy

    def _met(self, df: DataFrame, key: Column) -> DataFrame:
        return df.withColumn("_key", key).join(self.table, "_key", "left").drop("_key")

    def salted(self, df: DataFrame, key: Column, by: Column) -> DataFrame:
        """Adds ``_salt``: 0 for ordinary keys, else a part of the key chosen by the hash of ``by``."""
        if not self.any:
            return df.withColumn("_salt", F.lit(0))
        salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
        return self._met(df, key).withColumn("_salt", salt).drop("_parts")

    def copied(self, df: DataFrame, key: Column) -> DataFrame:
        """Adds ``_salt``: one copy of the row for each part of its key."""
        if not self.any:
            return df.withColumn("_salt", F.lit(0))
        return self._met(df, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
