"""Detection from a bounded sample: dialect, header, lattice of types, differences by name."""

import itertools
import os
import tempfile

import pytest

from deliverix.sources import csv_ingest
from deliverix.sources.csv_sniff import ABOVE, SchemaDifference, compare, join, sample_of, sniff, value_type
from deliverix.sources.schemas import ITEMS

HEADER = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value"
ROW = "o1,1,p1,s1,2018-01-03 00:00:00,10.5,1.2"


def differences(text):
    return sorted((d.kind, d.column) for d in compare(sample_of(text), ITEMS))


def test_lattice():
    for a, b in itertools.product(ABOVE, repeat=2):
        assert join(a, b) == join(b, a) and join(a, a) == a
        assert join(a, b) in ABOVE[a] & ABOVE[b]
        for c in ABOVE:
            assert join(join(a, b), c) == join(a, join(b, c))
    assert join("integer", "double") == "double" and join("integer", "timestamp") == "text" and join("empty", "timestamp") == "timestamp"
    assert [value_type(x) for x in ("", "12", "-1.5e3", "2018-01-01", "2018-01-01 10:00:00", "x", "1 2")] == [
        "empty", "integer", "double", "timestamp", "timestamp", "text", "text"]


def test_same_schema_has_no_difference():
    assert differences(f"{HEADER}\n{ROW}\n") == []
    assert differences(HEADER + "\n") == []
    assert differences(f"{HEADER}\n{ROW}\nbad,z,p1,s1,2018-01-02 10:00:00,1.0,1.0\n") == []  # one bad row is no other type


def test_renamed_column():
    assert differences(HEADER.replace("price", "cost") + f"\n{ROW}\n") == [("renamed", "price")]


def test_missing_and_extra_columns():
    assert differences(f"{HEADER},note\n{ROW},x\n") == [("extra", "note")]
    assert differences(HEADER.replace(",price", "") + "\no1,1,p1,s1,2018-01-03 00:00:00,1.2\n") == [("missing", "price")]


def test_reordered_columns():
    text = HEADER.replace("product_id,seller_id", "seller_id,product_id") + f"\n{ROW}\n"
    assert differences(text) == [("reordered", "product_id"), ("reordered", "seller_id")]


def test_retyped_columns():
    rows = "".join(f"o{k},one,p1,s1,03/01/2018,10,1.2\n" for k in range(5))
    found = {d.column: d for d in compare(sample_of(f"{HEADER}\n{rows}"), ITEMS)}
    assert {c: d.kind for c, d in found.items()} == {"order_item_id": "retyped", "shipping_limit_date": "retyped"}
    assert "text instead of integer" in str(found["order_item_id"])


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_dialect(delimiter, quote):
    text = delimiter.join(["id", "a", "b"]) + "\n" + "".join(
        delimiter.join([str(k), f"{quote}x{delimiter}y\nz{quote}{quote}{quote}", "it"]) + "\n" for k in range(9))
    s = sample_of(text)
    assert (s.delimiter, s.quote, s.columns) == (delimiter, quote, ("id", "a", "b"))
    assert s.values["a"][0] == f"x{delimiter}y\nz{quote}"


def _folder(text):
    d = tempfile.mkdtemp(prefix="deliverix-sniff-")
    with open(os.path.join(d, "items.csv"), "w") as f:
        f.write(text)
    return d


def test_sample_is_bounded(spark):
    s = sniff(spark, _folder(f"{HEADER}\n" + f"{ROW}\n" * 5000), lines=50)
    assert len(s.values["price"]) == 48 and s.type_of("price") == "double"
    assert sniff(spark, _folder("")) is None


def test_header_order_and_dialect_are_read(spark):
    """Reordered columns, an extra one and another delimiter give the same table."""
    files = {"items": (("items.csv",), ITEMS)}
    head = "price;order_id;order_item_id;note;product_id;seller_id;shipping_limit_date;freight_value\n"
    body = "".join(f"{k}.5;o{k};{k};'x;y';p1;s1;2018-01-03 00:00:00;1.2\n" for k in range(20))
    out = tempfile.mkdtemp(prefix="deliverix-out-")
    res = csv_ingest.ingest_csv(spark, _folder(head + body + "1.0;bad;x;n;p;s;2018-01-03 00:00:00;1.0\n"), out, files)
    assert res.tables["items"].columns == ITEMS.names
    assert sorted((r.order_id, r.order_item_id, r.price) for r in res.tables["items"].collect()) == sorted((f"o{k}", k, k + 0.5) for k in range(20))
    assert [tuple(r) for r in res.counts.collect()] == [("items", 20, 1)]


def test_renamed_column_stops_the_ingest(spark):
    files = {"items": (("items.csv",), ITEMS)}
    with pytest.raises(SchemaDifference, match="renamed column price: the header has cost in its place"):
        csv_ingest.ingest_csv(spark, _folder(HEADER.replace("price", "cost") + f"\n{ROW}\n"), tempfile.mkdtemp(), files)


def test_each_file_is_parsed_and_written_once(spark):
    out = tempfile.mkdtemp(prefix="deliverix-out-")
    files = {"items": (("items.csv",), ITEMS)}
    csv_ingest.ingest_csv(spark, _folder(f"{HEADER}\n{ROW}\n"), out, files)
    assert sorted(os.listdir(out)) == ["_quarantine", "items"]
    assert spark.read.parquet(f"{out}/_quarantine/items").count() == 0
    csv_ingest.ingest_csv(spark, _folder(f"{HEADER}\n" + f"{ROW}\n" * 3), out, files)  # again: replaced
    assert spark.read.parquet(f"{out}/items").count() == 3
