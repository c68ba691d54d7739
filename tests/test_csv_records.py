"""Splittable records: quote state across lines and byte ranges, against Spark's one-task reader and Python's csv module."""

import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from deliverix.sources.csv_ingest import CORRUPT, read_csv_permissive, with_corrupt
from deliverix.sources.csv_records import ends_inside, ranges, read_lines, records

SCHEMA = StructType([StructField("id", IntegerType()), StructField("a", StringType()), StructField("b", StringType())])


@pytest.fixture()
def small_ranges(spark):
    """Ranges of 200 bytes, so that a small file has many of them."""
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(text, name="a.csv", folder=None):
    folder = folder or tempfile.mkdtemp(prefix="deliverix-records-")
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return folder


def _field(rng):
    return rng.choice(["plain", '"quoted, comma"', '"two\nlines, ""x"" here\n\nend"', '""', "", '"a""\n""b"', '"' + "long\n" * rng.randint(1, 90) + '"', "é ü"])


def one_task(spark, path):
    return (spark.read.schema(with_corrupt(SCHEMA)).option("header", True).option("multiLine", True).option("escape", '"')
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def test_same_rows_as_the_one_task_reader(spark, small_ranges):
    rng = random.Random(2)
    folder = _write("id,a,b\n" + "".join(f"{i},{_field(rng)},{_field(rng)}\n" for i in range(300)))
    _write("id,a,b\n" + "".join(f"{i},{_field(rng)},{_field(rng)}\n" for i in range(300, 340)), "b.csv", folder)
    _write("id,a,b\n", "only_header.csv", folder)
    assert one_task(spark, folder).rdd.getNumPartitions() <= 3
    assert read_lines(spark, folder).rdd.getNumPartitions() > 20
    starts = ranges(read_lines(spark, folder)).collect()
    assert any(r.start for r in starts) and any(not r.start for r in starts)  # some ranges start inside quotes
    got = read_csv_permissive(spark, folder, SCHEMA, multiline=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, one_task(spark, folder).collect()), key=repr)


def test_line_breaks_inside_quotes_stay_as_they_are(spark, small_ranges):
    rng = random.Random(3)
    text = "id,a,b\r\n" + "".join(f'{i},"x\r\ny{rng.randint(0, 9)}\rz",{_field(rng)}\r\n' for i in range(60))
    folder = _write(text)
    got = sorted((r.id, r.a, r.b or "") for r in read_csv_permissive(spark, folder, SCHEMA, multiline=True).collect())
    want = sorted((int(r[0]), r[1], r[2]) for r in list(csv.reader(io.StringIO(text, newline="")))[1:])
    assert got == want


def test_broken_rows_spoil_only_themselves(spark, small_ranges):
    good = "".join(f'{i},"two\nlines",x\n' for i in range(40))
    folder = _write('id,a,b\n1,st"ray,quo"te\nx,bad,id\n2,too,many,fields\n3,few\n\n   \n4,"closed"junk,b\n' + good.replace("0,", "0,", 1))
    rows = read_csv_permissive(spark, folder, SCHEMA, multiline=True).collect()
    bad = [r for r in rows if r[CORRUPT] is not None]
    assert sorted(r[CORRUPT].split(",")[0] for r in bad) == ["2", "3", "x"]
    assert sum(r.a == "two\nlines" for r in rows) == 40
    assert [(r.a, r.b) for r in rows if r.id == 1 and r.a != "two\nlines"] == [('st"ray', 'quo"te')]


def test_unclosed_quote_comes_back_line_by_line(spark, small_ranges):
    folder = _write('id,a,b\n1,x,y\n2,"never closed,y\n' + "".join(f"{i},x,y\n" for i in range(3, 60)))
    lines = read_lines(spark, folder)
    whole = [r.value for r in records(lines, max_lines=1000).collect()]
    assert len(whole) == 2 and max(map(len, whole)) > 300
    alone = sorted(r.value for r in records(lines, max_lines=10).collect())
    assert len(alone) == 59 and '2,"never closed,y' in alone


def test_state_after_a_line(spark):
    lines = ["a,b", "", '"a",b', 'a,"b', '"a', '""', '"', '"""', 'x"', 'x",y', 'x","y', 'x""y', 'x"",', '""","""', 'a"b,c', '"a"b"c,"', ',"', '",', '","', '"","']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    outside, inside = ends_inside(F.col("value"))

    def state(line, quoted):
        at_start = not quoted
        k = 0
        while k < len(line):
            c = line[k]
            if quoted:
                if c == '"' and line[k + 1:k + 2] == '"':
                    k += 1
                elif c == '"':
                    quoted = False
            elif c == ",":
                at_start = True
                k += 1
                continue
            elif c == '"' and at_start:
                quoted = True
            at_start = False
            k += 1
        return quoted

    for r in df.select("value", outside.alias("o"), inside.alias("i")).collect():
        assert (r.o, r.i) == (state(r.value, False), state(r.value, True)), r.value


def test_long_lines_need_no_stack(spark):
    outside, inside = ends_inside(F.col("value"))
    df = spark.createDataFrame([('"' + 'ab""c,' * 200_000,), ('a,"b",' * 200_000 + '"x',), ('x' * 100 + '"' + ',"y"' * 200_000,)], "value string")
    assert [tuple(r) for r in df.select(outside, inside).collect()] == [(True, False), (True, True), (False, False)]
