"""Rows that fail to parse: delimited records, valid ones typed, others with a reason."""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a record, in order. Fixed values.
FIELDS = ["txn_id", "price", "date", "postcode", "property_type", "new_build", "tenure", "paon", "saon", "street", "locality", "town", "district", "county", "ppd_category", "record_status"]
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*\Z")
_PRICE = re.compile(r"[0-9]+\Z")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?: ([0-9]{2}):([0-9]{2}))?\Z")
_POSTCODE = re.compile(r"[A-Za-z]{1,2}[0-9][0-9A-Za-z]? *[0-9][A-Za-z]{2}\Z")
MAX_LONG = 2**63 - 1


def physical_lines(text: str) -> list[str]:
    """Lines with their ends; CR, LF and CRLF end a line, nothing else does."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Records from physical lines: a line that leaves a quote open takes the following ones."""
    held: list[str] = []
    quotes = 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "".join(held)
            held, quotes = [], 0
    if held:
        yield "".join(held)


def parse_record(raw: str | None, width: int = len(FIELDS)) -> tuple[list[str] | None, str | None]:
    """(fields, None) or (None, reason). Structure only: one record, strict quoting, ``width`` fields."""
    if raw is None:
        return None, "null"
    text = raw.rstrip("\r\n")
    records = list(assemble(physical_lines(text))) if "\n" in text or "\r" in text else [text]
    if not text.strip():
        return None, "empty"
    if len(records) > 1:
        return None, "line break outside quotes"
    try:
        rows = list(csv.reader(records, strict=True))
    except csv.Error as e:
        return None, "unclosed quote" if "unexpected end" in str(e) else "quoting"
    if len(rows) != 1:
        return None, "line break outside quotes"
    if len(rows[0]) != width:
        return None, "too few fields" if len(rows[0]) < width else "too many fields"
    if '"' in text and not _RECORD.match(text):
        return None, "quoting"  # the strict reader allows a quote within an unquoted field
    return rows[0], None


def typed_fields(f: list[str]) -> tuple[int | None, dt.datetime | None, str | None, str | None]:
    """price, date, postcode and the reason, which is None for a valid record."""
    price, date, code = f[1].strip(" "), f[2].strip(" "), f[3].strip()
    if not _PRICE.match(price) or not 0 < (value := int(price) if len(price.lstrip("0")) < 20 else MAX_LONG + 1):
        return None, None, None, "price"
    if not (m := _DATE.match(date)):
        return None, None, None, "date"
    try:
        when = dt.datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0))
    except ValueError:
        return None, None, None, "date"
    if code and not _POSTCODE.match(code):
        return None, None, None, "postcode"
    return (value if value <= MAX_LONG else None), when, code.upper() or None, None


def parsed_schema(key: T.StructField) -> T.StructType:
    kinds = {"price": T.LongType(), "date": T.TimestampNTZType()}
    return T.StructType([key, *(T.StructField(n, kinds.get(n, T.StringType())) for n in FIELDS), T.StructField("reason", T.StringType())])


def parse_records(df: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per input row: typed fields for valid records, else NULL fields and ``reason``.

    Reasons: null, empty, unclosed quote, quoting, line break outside quotes, too few fields, too many fields, price,
    date, postcode. Only ``key`` and ``raw`` are read; further columns of the input don't matter. Repeated rows stay.
    A digits-only price beyond 64 bits is valid and NULL. Records are parsed in mapPartitions style, batch by batch;
    memory holds one Arrow batch and nothing is shuffled.
    """
    schema = parsed_schema(T.StructField(key, df.schema[key].dataType))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        csv.field_size_limit(2**31 - 1)
        arrow = to_arrow_schema(schema)
        blank = [None] * len(FIELDS)
        for b in batches:
            out = []
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fields, reason = parse_record(r)
                if reason is None:
                    price, when, code, reason = typed_fields(fields)
                    fields = [fields[0], price, when, code, *fields[4:]]
                out.append((k, *(fields if reason is None else blank), reason))
            cols = list(zip(*out)) if out else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(key, F.col(raw).cast("string").alias("raw")).mapInArrow(run, schema)


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, rejected rows with their reason)."""
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def read_delimited(spark, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file_name, line_no, raw) of delimited files whose quoted fields may hold line breaks: assembled quote-aware,
    file by file, since a quote opened in one block may close in another. For splittable sizes, write one file per
    day or month."""
    schema = "file_name string, line_no long, raw string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = list(assemble(physical_lines(bytes(content).decode(encoding, "replace"))))
                yield pd.DataFrame({"file_name": name.rpartition("/")[2], "line_no": range(1, len(rows) + 1), "raw": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
