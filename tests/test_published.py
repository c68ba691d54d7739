"""Published versions: a failed export is never seen, views over an export equal those of the build."""

import os
import tempfile

import pytest

from deliverix.plans.build import build_for
from deliverix.sources import published, sinks
from deliverix.sources.published import Published, newest_version

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def build(spark):
    return build_for(spark, SF)


@pytest.fixture(scope="module")
def out(build):
    path = tempfile.mkdtemp(prefix="deliverix-published-") + "/kpi"
    assert newest_version(build.spark, path) == 0
    assert build.publish(path) == 1
    return path


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_views_over_an_export_equal_those_of_the_build(spark, build, out):
    p = Published(spark, out)
    assert p.version == 1 and p.rows["otdr"] == build.otdr.count()
    same(p.kpi_cards(), build.kpi_cards)
    same(p.filter_domains(), build.filter_domains)
    for name in ("view_categories", "view_sellers", "view_states", "view_corridors", "view_velocity"):
        same(getattr(p, name)(), getattr(build, name)())
    same(p.view_sellers(150, 7), build.view_sellers(150, 7))
    same(p.view_states(["NATION_1"]), build.view_states(["NATION_1"]))


def test_failed_export_leaves_the_one_before(spark, build, out, monkeypatch):
    reader = Published(spark, out)
    before = sorted(map(tuple, reader.view_states().collect()))
    write, done = sinks.write_frame, []

    def failing(df, path, fmt="csv"):
        if len(done) == 5:
            raise OSError("disk full")
        done.append(path)
        write(df, path, fmt)

    monkeypatch.setattr(sinks, "write_frame", failing)
    version = newest_version(spark, out)
    with pytest.raises(OSError, match="disk full"):
        build.publish(out)
    monkeypatch.undo()
    assert os.path.isdir(f"{out}/versions/{version + 1:08d}")  # half an export lies there
    assert newest_version(spark, out) == version and not reader.refresh()
    assert sorted(map(tuple, reader.view_states().collect())) == before
    assert build.publish(out) == version + 1  # the next attempt takes the folder
    assert sorted(map(tuple, reader.view_states().collect())) == before  # valid until the reader follows
    assert reader.refresh() and reader.version == version + 1
    assert sorted(map(tuple, reader.view_states().collect())) == before


def test_a_version_is_committed_once(spark, out):
    version = newest_version(spark, out)
    rows = spark.createDataFrame([("t", 1)], "table_name string, rows long")

    def second_writer(folder):
        published.publish(spark, out, lambda f: rows, {"t": rows.schema})  # another writer commits this version first
        return rows

    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        published.publish(spark, out, second_writer, {"t": rows.schema})
    assert newest_version(spark, out) == version + 1
    with pytest.raises(RuntimeError, match="not written: u"):
        published.publish(spark, out, lambda f: rows, {"u": rows.schema})
    with pytest.raises(FileNotFoundError, match="no version 999"):
        Published(spark, out, 999)
