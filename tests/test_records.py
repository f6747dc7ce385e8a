import csv
import io

import pytest

from terrane.operators.records import FIELDS, assemble, parse_record, parse_records, physical_lines, read_delimited, split_records, typed_fields

GOOD = ["{id}", "1000", "2020-02-29 00:00", "AB1 2CD", "D", "N", "F", "1", "", "A ROAD", "", "TOWN", "DISTRICT", "COUNTY", "A", "A"]


def _line(quote=csv.QUOTE_ALL, **changes):
    f = [changes.get(n, v) for n, v in zip(FIELDS, GOOD)]
    out = io.StringIO()
    csv.writer(out, quoting=quote, lineterminator="").writerow(f)
    return out.getvalue()


@pytest.mark.parametrize(
    "raw, reason",
    [
        (_line(), None), (_line(csv.QUOTE_MINIMAL), None), (_line() + "\r\n", None), (_line(street='THE "OLD" MILL, X'), None), (_line(street="TWO\r\nLINES"), None), (_line(price="  12 "), None),
        (_line(postcode=""), None), (_line(postcode="  "), None), (_line(postcode="ab1   2cd"), None), (_line(postcode="A1 2CD"), None), (_line(postcode="AB1C2DE"), None), (_line(date="2020-02-29"), None),
        (None, "null"), ("", "empty"), (" \r\n", "empty"), (_line(street="x")[:-1], "unclosed quote"), ('"a"b,' + _line(), "quoting"), (_line(csv.QUOTE_MINIMAL).replace("A ROAD", 'A "B" ROAD'), "quoting"),
        (_line(csv.QUOTE_MINIMAL).replace("A ROAD", ' "A ROAD"'), "quoting"), (_line() + ",x", "too many fields"), ("a,b", "too few fields"), (_line(csv.QUOTE_MINIMAL).replace("TOWN", "TO\nWN"), "line break outside quotes"),
        (_line() + "\n" + _line(), "line break outside quotes"), (_line(price="0"), "price"), (_line(price="1.5"), "price"), (_line(price="-1"), "price"), (_line(price="١٢"), "price"), (_line(price="1_0"), "price"),
        (_line(date="2019-02-29"), "date"), (_line(date="2020-01-01  00:00"), "date"), (_line(date="2020-01-01 24:00"), "date"), (_line(date="2020-1-1"), "date"), (_line(date=""), "date"), (_line(date="0000-01-01"), "date"),
        (_line(postcode="ABC 1DE"), "postcode"), (_line(postcode="АB1 2CD"), "postcode"), (_line(postcode="AB1 2CDE"), "postcode"), (_line(street="X" * 200_000), None),
    ],
)
def test_reasons(raw, reason):
    csv.field_size_limit(2**31 - 1)
    fields, why = parse_record(raw)
    assert (typed_fields(fields)[3] if why is None else why) == reason


def test_table(spark):
    rows = [(1, _line(), "x"), (1, _line(), "x"), (2, None, "y"), (3, _line(price="9" * 25), "z"), (4, "junk", None)]
    df = spark.createDataFrame(rows, "line_id long, raw string, price string")
    good, bad = split_records(parse_records(df, "line_id", "raw"))
    g = sorted((r["line_id"], r["price"]) for r in good.collect())
    assert g == [(1, 1000), (1, 1000), (3, None)]
    assert {(r["line_id"], r["reason"]) for r in bad.collect()} == {(2, "null"), (4, "too few fields")}
    assert good.schema["date"].dataType.typeName() == "timestamp_ntz"
    assert parse_records(df.limit(0), "line_id", "raw").count() == 0


def test_assembly(spark, tmp_path):
    text = 'a,"b\nc"\r\nd,e\n"f'
    assert list(assemble(physical_lines(text))) == ['a,"b\nc"\r\n', "d,e\n", '"f']
    (tmp_path / "x.csv").write_bytes(text.encode())
    got = read_delimited(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["file_name"], r["line_no"], r["raw"]) for r in got] == [("x.csv", 1, 'a,"b\nc"\r\n'), ("x.csv", 2, "d,e\n"), ("x.csv", 3, '"f')]
