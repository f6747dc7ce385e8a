from pyspark.sql import functions as F

from terrane.operators.integrity import orphan_report, orphans, reference_status

PARENTS = "key string, a string, b string, extra int"
REFS = "id long, ref string, month string, key string"


def _status(spark, refs, parents, rows_per_task=100):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    return reference_status(r, p, ref_key=F.col("ref"), ref_period=F.col("month"), parent_key=F.col("key"), parent_from=F.col("a"), parent_to=F.col("b"), carry={"id": F.col("id"), "key": F.col("key")}, spread=F.col("id"), rows_per_task=rows_per_task)


def test_states_of_the_parent(spark):
    parents = [("AB1 2CD", "201001", "201206", 1), ("AB1 2CD", "201401", "", 2), ("AB1 2CD", "201401", "", 2), ("x y", "201501", None, 3), (None, "200001", None, 4), ("nofrom", None, None, 5)]
    refs = [(1, "ab12cd", "201102", "k"), (2, "AB1 2CD", "201301", "k"), (3, "AB1 2CD", "200901", "k"), (4, " X\tY ", "201501", "k"), (5, "xy", "201412", None), (6, "other", "201412", "k"), (7, "  ", "201412", "k"), (8, None, "201412", "k"), (9, "xy", None, "k"), (10, "nofrom", "201001", "k"), (1, "ab12cd", "201102", "k")]
    got = sorted((r["id"], r["status"]) for r in _status(spark, refs, parents).collect())
    assert got == [(1, "valid"), (1, "valid"), (2, "deleted"), (3, "late"), (4, "valid"), (5, "late"), (6, "missing"), (7, "none"), (8, "none"), (9, "undated"), (10, "undated")]


def test_hot_key_is_spread_and_complete(spark):
    refs = [(i, "hot" if i % 3 else f"k{i}", "201001", "k") for i in range(900)]
    s = _status(spark, refs, [("HOT", "200001", None, 0)] * 3)
    assert s.where("status = 'valid'").count() == 600
    assert orphans(s).count() == 300


def test_empty_tables(spark):
    assert _status(spark, [], []).count() == 0
    assert [r["status"] for r in _status(spark, [(1, "a", "201001", "k")], []).collect()] == ["missing"]


def test_report_counts_per_period(spark):
    s = _status(spark, [(1, "a", "201001", "k"), (2, "a", "201001", "k"), (3, "b", "201002", "k")], [("b", "201001", None, 1)])
    rows = orphan_report(s, "refs", F.col("ref_period")).collect()
    assert [tuple(r) for r in rows] == [("refs", "201001", "missing", 2)]
