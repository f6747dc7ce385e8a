import http.server
import threading
import urllib.parse

import pytest
from pyspark.sql import types as T

from terrane import run
from terrane.sources import archives, sinks
from terrane.sources import tables as S
from terrane.streaming import ingest


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x",5\n"y",\n')
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in S.typed_csv(spark, str(tmp_path / "a.csv"), schema).collect()] == [("x", 5), ("y", None)]
    (tmp_path / "b.csv").write_text("h,k\n1,\n")
    assert [tuple(r) for r in S.text_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "")]
    (tmp_path / "c.csv").write_bytes("Some title\nURN,Name\n1,Caf\xe9\n".encode("cp1252"))
    df = S.text_csv_with_preamble(spark, str(tmp_path / "c.csv"), "URN")
    assert [tuple(r) for r in df.collect()] == [("1", "Café")]
    (tmp_path / "d.csv").write_text("Title\nURN,Name\nTitle\n1, a \nURN,Name\n")
    assert [tuple(r) for r in S.text_csv_with_preamble(spark, str(tmp_path / "d.csv"), "URN").collect()] == [("Title", None), ("1", " a "), ("URN", "Name")]
    (tmp_path / "d.csv").unlink()
    with pytest.raises(ValueError):
        S.text_csv_with_preamble(spark, str(tmp_path / "b.csv"), "URN")
    u = S.tagged_files(spark, [str(tmp_path / "b.csv")], lambda s, p: S.text_csv(s, p))
    assert u.columns == ["h", "k", "source"] and u.collect()[0]["source"] == "b"
    assert S.digest_manifest(spark, str(tmp_path)).count() == 3


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, price int")
    with pytest.raises(ValueError):
        S.guard_columns(df, forbidden=("Price",))
    with pytest.raises(ValueError):
        S.guard_columns(df, required=("b",))
    assert S.guard_columns(df, required=("A",)) is df


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 40}", 10 + i, f"2020-01-{1 + i % 28:02d} 00:00:00") for i in range(60)], "txn_id string, price int, t string").selectExpr("txn_id", "price", "timestamp(t) as date")
    rows.repartition(3).write.parquet(str(tmp_path / "sales.parquet"))
    s = ingest.without_repeats(ingest.stream_table(spark, str(tmp_path), "sales"), "txn_id", "date")
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", 10, f"2020-0{1 + i % 5}-05 00:00:00") for i in range(50)] + [("end", 1, "2021-06-01 00:00:00")], "txn_id string, price int, t string").selectExpr("txn_id", "price", "timestamp(t) as date")
    rows.repartition(1).write.parquet(str(tmp_path / "sales.parquet"))
    assert S.schema_names(spark, str(tmp_path / "sales.parquet")) == ["txn_id", "price", "date"]
    w = ingest.windowed_counts(ingest.stream_table(spark, str(tmp_path), "sales"), "date", "10 days", "1 day")
    ingest.drain(w, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["n"], r["total"]) for r in out) == [(10, 100)] * 5  # the last window stays open


def test_optional_and_coerced(spark, tmp_path):
    (tmp_path / "s.csv").write_text("kind,status,east,x\nRLY,active,5,1\nBUS,active,6,1\nRLY,old,7,1\n")
    df = S.optional_csv(spark, str(tmp_path / "s.csv"), ["east"], "kind in ('RLY', 'MET') and status = 'active'")
    assert [r[0] for r in df.collect()] == ["5"] and S.optional_csv(spark, str(tmp_path / "none.csv"), ["east"]) is None
    (tmp_path / "p.csv").write_text("urn,year,m,share\n1,2020,7.5,\n2,x,,0.1\n")
    got = S.coerced_csv(spark, str(tmp_path / "p.csv"), ["urn", "m"], {"year": "int", "m": "double", "share": "double"}, {"share": "0"}).collect()
    assert [tuple(r) for r in got] == [("1", 2020, 7.5, 0.0), ("2", None, None, 0.1)]
    with pytest.raises(ValueError):
        S.coerced_csv(spark, str(tmp_path / "p.csv"), ["lacking"], {})
    cat = {r["name"]: r["kind"] for r in S.file_catalogue(spark, str(tmp_path), {"stations": r"^s\.csv$", "any": r"\.csv$"}).collect()}
    assert cat == {"s.csv": "stations", "p.csv": "any"}


def test_forms_over_http(tmp_path):
    page = '<input name="token" value="t1"><input name="list[0].Tag" value="all"><input name="list[0].Selected" value="false"><input type="submit">'
    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.answer("done" if len(asked) > 3 else "wait")

        def do_POST(self):
            self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def answer(self, text):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    fields = archives.ticked(archives.form_fields(page), {"all"})
    assert fields == {"token": "t1", "list[0].Tag": "all", "list[0].Selected": "true"}
    with pytest.raises(ValueError):
        archives.ticked(fields, {"none"})
    where, text = archives.post_form(url, fields)
    assert where == url and dict(urllib.parse.parse_qsl(text)) == fields
    assert archives.poll(url, lambda t: t == "done", pause=0) == "done" and len(asked) == 4
    with pytest.raises(TimeoutError):
        archives.poll(url, lambda t: False, tries=2, pause=0)
    server.shutdown()


def test_runner(spark, tmp_path):
    assert run.chosen(["a", "b", "c", "d"], first="b", last="c") == ["b", "c"] and run.chosen(["a", "b"], only=["b"]) == ["b"]
    with pytest.raises(KeyError):
        run.chosen(["a"], last="z")
    out = run.run_queries(spark, {"q": lambda s, d: s.range(3)}, "", str(tmp_path), ["q"])
    assert out == ["q"] and spark.read.parquet(str(tmp_path / "q.parquet")).count() == 3
    (tmp_path / "f").write_text("x")
    run.main(["seal", str(tmp_path / "f"), str(tmp_path / "f.seal"), "--by", "me"])
    run.main(["check", str(tmp_path / "f"), str(tmp_path / "f.seal")])
    assert [p.rpartition("/")[2] for p in sinks.write_tables({"t": spark.range(1)}, str(tmp_path / "tables"))] == ["t.csv"]
