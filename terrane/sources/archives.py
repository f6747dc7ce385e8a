"""Archives, forms and downloads."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, content) of the members of ZIP files whose name matches a pattern, unpacked where they are read."""

    def run(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    found = [m for m in z.namelist() if re.search(pattern, m)]
                    yield pd.DataFrame({"archive": [name.rpartition("/")[2]] * len(found), "member": found, "content": [z.read(m) for m in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def html_inputs(html: Column) -> Column:
    """Map from name to value of a page's input fields; a field without a value has '', of one name the first counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<input\b[^>]*>"), F.lit(0))
    attr = lambda t, a: F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    pairs = F.filter(F.transform(tags, lambda t: F.struct(attr(t, "name").alias("key"), attr(t, "value").alias("value"))), lambda p: p["key"] != "")
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), 1)["value"]))


def fetch(url: str, dest: str, manifest: str, timeout: float = 60) -> dict:
    """Download once: kept if its size is that of the manifest; written beside and renamed, so no half file stays."""
    known = json.loads(Path(manifest).read_text()) if Path(manifest).exists() else {}
    name = Path(dest).name
    if name in known and Path(dest).exists() and Path(dest).stat().st_size == known[name]["bytes"]:
        return known[name]
    digest, size, part = hashlib.sha256(), 0, f"{dest}.part"
    with urllib.request.urlopen(url, timeout=timeout) as r, open(part, "wb") as f:  # noqa: S310
        while block := r.read(1 << 20):
            f.write(block)
            digest.update(block)
            size += len(block)
        want = r.headers.get("Content-Length")
    if want is not None and int(want) != size:
        os.unlink(part)
        raise OSError(f"{url}: {size} of {want} bytes")
    os.replace(part, dest)
    known[name] = {"url": url, "bytes": size, "sha256": digest.hexdigest(), "retrieved_utc": datetime.now(timezone.utc).isoformat()}
    Path(manifest).write_text(json.dumps(known, indent=1, sort_keys=True))
    return known[name]


def form_fields(html: str) -> dict[str, str]:
    """The input fields of a page at the driver, as ``html_inputs`` reads them from a column."""
    out: dict[str, str] = {}
    for tag in re.findall(r"(?is)<input\b[^>]*>", html):
        value = {k: m[1] for k in ("name", "value") if (m := re.search(rf"(?is)\b{k}\s*=\s*[\"']([^\"']*)[\"']", tag))}
        if value.get("name"):
            out.setdefault(value["name"], value.get("value", ""))
    return out


def ticked(fields: dict[str, str], wanted: set[str], tag: str = ".Tag", selected: str = ".Selected") -> dict[str, str]:
    """The fields with those entries selected whose tag is wanted; an error if one isn't offered."""
    marks = {n[: -len(tag)] + selected: "true" for n, v in fields.items() if n.endswith(tag) and v in wanted}
    lacking = wanted - {v for n, v in fields.items() if n.endswith(tag)}
    if lacking:
        raise ValueError(f"not offered: {sorted(lacking)}")
    return {**fields, **marks}


def post_form(url: str, fields: dict[str, str], timeout: float = 60) -> tuple[str, str]:
    """Send a form; (address that the answer came from, its text)."""
    with urllib.request.urlopen(url, urllib.parse.urlencode(fields).encode(), timeout=timeout) as r:  # noqa: S310
        return r.geturl(), r.read().decode("utf-8", "replace")


def poll(url: str, ready: Callable[[str], bool], tries: int = 120, pause: float = 5.0, timeout: float = 60) -> str:
    """Ask for a page until it is ready; an error after so many tries."""
    for i in range(tries):
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            text = r.read().decode("utf-8", "replace")
        if ready(text):
            return text
        if i + 1 < tries:
            time.sleep(pause)
    raise TimeoutError(f"{url} was not ready after {tries} tries")


def yearly_files(folder: str, first: int, last: int, name: str = "pp-{year}.csv") -> list[str]:
    """The files of a range of years, in order; a missing one is an error."""
    paths = [f"{folder}/{name.format(year=y)}" for y in range(first, last + 1)]
    lacking = [p for p in paths if not os.path.exists(p)]
    if lacking:
        raise FileNotFoundError(", ".join(lacking))
    return paths


def geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(properties, wkt) of the polygons in GeoJSON files on the metric grid; another stated system is refused."""
    schema = "crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    bad = whole.where("j.crs.properties.name is not null and j.crs.properties.name not rlike '27700$'").limit(1).collect()
    if bad:
        raise ValueError(f"coordinates in {bad[0]['j']['crs']['properties']['name']}, not on the metric grid")
    f = whole.select(F.explode("j.features").alias("f")).where("f.geometry.type in ('Polygon', 'MultiPolygon')")
    rings = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[(\s*\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*)\s*\]"), F.lit(1))
    points = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"\[\s*([^\[\],\s]+\s*,\s*[^\[\],\s]+)[^\[\]]*\]"), F.lit(1)), lambda p: F.regexp_replace(p, r"\s*,\s*", " ")), ", ")
    return f.select(F.col("f.properties").alias("properties"), F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), points(r), F.lit(")"))), ", "), F.lit(")")).alias("wkt"))
