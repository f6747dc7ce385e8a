"""Parquet tables of one folder, and typed text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files); columns and filters are pruned by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def schema_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footers alone; no row is read."""
    return spark.read.parquet(path).schema.fieldNames()


def guard_columns(df: DataFrame, forbidden: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """Refuse a table that holds a forbidden column or lacks a required one (names without regard to case)."""
    have = {c.lower() for c in df.columns}
    bad = [c for c in forbidden if c.lower() in have]
    lacking = [c for c in required if c.lower() not in have]
    if bad or lacking:
        raise ValueError(f"forbidden columns present: {bad}; required columns missing: {lacking}")
    return df


def _charset(encoding: str) -> str:
    """Spark reads a few character sets only; Windows-1252 is read as Latin-1 and mended by ``_mended``."""
    return "iso-8859-1" if encoding.lower() in ("windows-1252", "cp1252") else encoding


def _mended(df: DataFrame, encoding: str) -> DataFrame:
    """Strings that were read as Latin-1 with the 27 letters and marks in which Windows-1252 differs."""
    if _charset(encoding) == encoding:
        return df
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    a, b = ("".join(x) for x in zip(*((x, y) for x, y in pairs if y)))
    return df.select(*(F.translate(f.name, a, b).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def typed_csv(spark: SparkSession, path, schema: T.StructType, header: bool = False, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Headerless or headed CSV with a fixed schema; nothing is inferred. ``path`` may be a glob or a list."""
    r = spark.read.schema(schema).option("header", header).option("encoding", _charset(encoding)).option("multiLine", multi_line)
    return _mended(r.option("escape", '"').option("mode", "PERMISSIVE").csv(path), encoding)


def text_csv(spark: SparkSession, path, encoding: str = "UTF-8", keep_empty: bool = True) -> DataFrame:
    """Headed CSV with every column a string. ``keep_empty``: an empty field stays '' instead of NULL."""
    df = spark.read.option("header", True).option("encoding", _charset(encoding)).option("escape", '"').option("inferSchema", False)
    if keep_empty:
        df = df.option("nullValue", "\u0000").option("emptyValue", "")
        return _mended(df.csv(path), encoding).na.fill("")
    return _mended(df.csv(path), encoding)


def text_csv_with_preamble(spark: SparkSession, path: str, marker: str, encoding: str = "windows-1252", within: int = 100) -> DataFrame:
    """Headed CSV file whose header may come after title lines: the header is the first line that contains ``marker``.

    Only the file's first lines are read at the driver to find the header; a file without it there is an error. Lines
    further down that equal a title or the header are data.
    """
    # the text source knows UTF-8 only; a CSV without separator and quotes gives whole lines in any encoding
    raw = spark.read.schema("value string").option("encoding", _charset(encoding)).option("sep", "\u0001").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    head = _mended(raw.csv(path), encoding).limit(within).collect()
    at = next((i for i, r in enumerate(head) if marker in (r[0] or "")), None)
    if at is None:
        raise ValueError(f"no header with {marker!r} within the first lines of {path}")
    names = [c.strip().strip('"') for c in head[at][0].split(",")]
    # the reader gives a file's lines in order, so the header's is told from an equal line further down by its place:
    # the first partition holds the start of the file, and in it the first lines are left out by their number
    lines = raw.csv(path).select("value", F.monotonically_increasing_id().alias("_at"))
    parsed = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)))
    return _mended(lines.where(F.col("_at") > at).select("value"), encoding).select(parsed.alias("r")).select("r.*")


def optional_csv(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame | None:
    """Some columns (strings) of a headed CSV, with a filter; None where there is no such file."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
        return None
    df = text_csv(spark, path)
    df = df.where(where) if where else df
    return df.select(*columns)


def coerced_csv(spark: SparkSession, path: str, required: list[str], types: dict[str, str], empty: dict[str, str] | None = None) -> DataFrame:
    """A headed CSV that must have certain columns, some of them coerced to a type: what can't be read as it is NULL.
    ``empty``: what an empty field of a column stands for; elsewhere it is NULL for coerced columns and '' for others."""
    df = guard_columns(text_csv(spark, path), required=tuple(required))
    filled = {c: F.when(F.col(f"`{c}`") == "", F.lit(v)).otherwise(F.col(f"`{c}`")) for c, v in (empty or {}).items()}
    return df.select(*(filled.get(c, F.col(f"`{c}`")).try_cast(types[c]).alias(c) if c in types else filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))


def file_catalogue(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(name, kind, bytes, modified) of the files below a path, each with the first kind whose pattern its name matches
    (NULL if none does); nothing of their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    kind = F.coalesce(*(F.when(F.col("name").rlike(rx), k) for k, rx in kinds.items()), F.lit(None).cast("string"))
    return files.select("name", kind.alias("kind"), "bytes", "modified")


def tagged_files(spark: SparkSession, paths: list[str], reader, tag: str = "source") -> DataFrame:
    """Union of several files in sorted name order by column name, each row tagged with its file's stem."""
    out = None
    for path in sorted(paths):
        stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
        part = reader(spark, path).withColumn(tag, F.lit(stem))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def digest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a path, computed where the bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
