"""Queries p4 (percentiles) and p8 to p10 (documents), with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm import abuse, packing, quantiles, tokenizer
from terrane.plans.problems import circles, sales_within
from terrane.session import cut
from terrane.sources.tables import table

C = F.col


# ---- p4: percentiles of large columns

RING_M = 400.0
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _ring_sales(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sales just outside each circle: (boundary_id, txn_id, price); of differing repeats the least price."""
    near = sales_within(spark, d, circles(spark, d, C("radius_m") + RING_M, C("radius_m").alias("inner")), "price")
    ring = near.where("distance >= inner and distance < reach and price is not null")
    return ring.groupBy(C("urn").alias("boundary_id"), "txn_id").agg(F.min("price").alias("price"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ring = cut(_ring_sales(spark, d))  # read twice: for the summaries and for the count inside the bracket
    s = quantiles.merge(quantiles.summarise(ring, ["boundary_id"], C("price")), ["boundary_id"])
    q = quantiles.quantiles(s, ["boundary_id"], [0.5, 0.500001])
    bracket = q.select("boundary_id", F.array_min("low").alias("low"), F.array_max("high").alias("high"))
    exact = quantiles.exact_median(ring, "boundary_id", "price", bracket)
    published = table(spark, d, "per_boundary").select("boundary_id", "median_price_outside")
    return published.join(exact, "boundary_id").where(F.abs(C("median_price_outside") - C("median")) > 0.05 * C("median")).select("boundary_id").distinct()


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of price per boundary (sales just outside its circle), district and quarter, from mergeable summaries
    with their rank-error bound. A sale counts once in a group, of differing repeats with the least price."""
    sales = table(spark, d, "sales").where("price is not null").select("txn_id", "price", F.explode(F.array(F.struct(F.lit("district").alias("kind"), C("district").alias("name")), F.struct(F.lit("quarter").alias("kind"), C("year_quarter").alias("name")))).alias("g"))
    sales = sales.groupBy("g.kind", "g.name", "txn_id").agg(F.min("price").alias("price")).select("kind", "name", "price")
    ring = _ring_sales(spark, d).select(F.lit("boundary").alias("kind"), C("boundary_id").alias("name"), "price")
    s = quantiles.merge(quantiles.summarise(sales.unionByName(ring), ["kind", "name"], C("price")), ["kind", "name"])
    q = quantiles.quantiles(s, ["kind", "name"], PROBS)
    return q.select("kind", "name", "n", "err", *(F.get("value", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(PROBS)))


# ---- p8 to p10: documents


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = tokenizer.Tokenizer.load(spark).fitted(docs, "text")
    return packing.pack(docs, "doc_id", t.length(C("text")))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers hold: documents placed, containers over the capacity, places that overlap, and containers
    left out of the numbering."""
    p = cut(p9_pack(spark, d))
    after = F.lead("position").over(Window.partitionBy("container").orderBy("position"))
    placed = p.where("container is not null").withColumn("_over", (C("position") + C("size") > after).cast("long"))
    per = placed.groupBy("container").agg(F.sum("size").alias("held"), F.max(C("position") + C("size")).alias("end"), F.sum("_over").alias("over"))
    one = per.agg(F.count(F.when((C("held") > packing.CAPACITY) | (C("end") > packing.CAPACITY), 1)).alias("overfull"), F.coalesce(F.sum("over"), F.lit(0)).alias("overlapping"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("skipped"))
    return one.crossJoin(p.agg(F.countDistinct("doc_id").alias("documents")))  # two single rows


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score(docs, abuse.train(docs, table(spark, d, "content_reviews")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("toxic").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, found ones and their share per source."""
    docs = table(spark, d, "documents")
    model = abuse.train(docs, table(spark, d, "content_reviews"))
    by = abuse.score(docs, model, carry=["source"]).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(C("toxic").cast("long")).alias("n_found"))
    return by.withColumn("rate", C("n_found") / C("n_docs"))


QUERIES = {f.__name__: f for f in (p4_found, p4_percentiles, p8_ids, p9_pack, p9_check, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {
    "p4_found": """
WITH r AS (SELECT b.urn, s.txn_id, min(s.price) price FROM sales s, boundary b WHERE b.radius_m IS NOT NULL AND s.price IS NOT NULL AND NOT isnan(s.easting) AND NOT isnan(s.northing)
  AND sqrt((s.easting - b.easting) * (s.easting - b.easting) + (s.northing - b.northing) * (s.northing - b.northing)) >= b.radius_m
  AND sqrt((s.easting - b.easting) * (s.easting - b.easting) + (s.northing - b.northing) * (s.northing - b.northing)) < b.radius_m + 400 GROUP BY ALL),
m AS (SELECT urn, quantile_cont(price, 0.5) med FROM r GROUP BY urn)
SELECT DISTINCT p.boundary_id FROM per_boundary p JOIN m ON p.boundary_id = m.urn WHERE abs(p.median_price_outside - med) > 0.05 * med""",
    "p9_check": "SELECT 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS skipped, count(DISTINCT doc_id) AS documents FROM documents",
}
