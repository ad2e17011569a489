"""Tables in buckets: only changed buckets get new files, and a change counts as a whole."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from strom.operators import upsert
from strom.operators.buckets import BucketTable

SCHEMA = "k bigint, a string, b double"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def content(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    made = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    made.upsert_all(rows(spark, [(i, f"a{i}", i / 2) for i in range(200)]))
    return made


def test_an_increment_rewrites_only_the_buckets_it_changes(spark, table):
    before, state = files(table.path), table.state()
    touched = table.upsert_changed(rows(spark, [(3, "new", 0.0), (4, "a4", 2.0), (500, "more", None)]), ["a"])
    assert sorted(map(tuple, touched.collect())) == [(3, "updated"), (500, "inserted")]  # the fourth differs in no tracked column
    after = table.state()
    moved = {b for b in after if after[b] != state.get(b)}
    expected = {r.b for r in spark.createDataFrame([(3,), (500,)], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    assert moved == expected and len(moved) < 8
    assert {f: t for f, t in files(table.path).items() if f in before} == before  # no old file is touched
    assert table.read().count() == 201 and table.read().where("k = 3").first().a == "new" and table.read().where("k = 4").first().a == "a4"


def test_nothing_is_written_where_nothing_changes(spark, table):
    before, version = files(table.path), table.version()
    assert table.upsert_changed(rows(spark, [(i, f"a{i}", -1.0) for i in range(0, 200, 7)]), ["a"]).count() == 0
    assert files(table.path) == before and table.version() == version
    assert table.upsert_all(rows(spark, [])) == [] and table.replace_children(rows(spark, []), rows(spark, [])) == []


def test_the_plain_operators_give_the_same(spark, table):
    stored = rows(spark, [(i, f"a{i}", i / 2) for i in range(200)])
    change = rows(spark, [(i, "x" if i % 3 else f"a{i}", None) for i in range(150, 260)] + [(None, "no key", 1.0)])
    wanted, _ = upsert.upsert_changed(stored, change, "k", ["a", "b"])
    table.upsert_changed(change, ["a", "b"])
    assert content(table.read()) == content(wanted)
    again = rows(spark, [(i, "y", 0.0) for i in range(0, 300, 50)])
    everything = upsert.upsert_all(table.read(), again, "k")
    expected = content(everything)
    table.upsert_all(again)
    assert content(table.read()) == expected


def test_a_null_key_is_a_key(spark, table):
    for value in ("one", "two"):
        table.upsert_changed(rows(spark, [(None, value, None)]), ["a"])
    assert [r.a for r in table.read().where("k is null").collect()] == ["two"]


def test_children_of_touched_parents_are_replaced(spark, tmp_path):
    children = BucketTable(spark, str(tmp_path / "c"), "parent bigint, n int", ["parent"], buckets=4)
    make = lambda pairs: spark.createDataFrame(pairs, "parent bigint, n int")
    children.upsert_all(make([(p, n) for p in range(20) for n in range(3)] + [(99, n) for n in range(500)]))
    state = children.state()
    changed = children.replace_children(make([(1, 0), (2, 0), (99, 0)]).select("parent"), make([(1, 7), (99, 8), (3, 9)]))
    got = {}
    for r in children.read().collect():
        got.setdefault(r.parent, []).append(r.n)
    assert got[1] == [7] and 2 not in got and got[99] == [8] and sorted(got[3]) == [0, 1, 2] and len(got) == 20
    assert all(children.state()[b] == state[b] for b in state if b not in changed)


def test_a_run_that_dies_before_the_log_changes_nothing(spark, table, monkeypatch):
    before = content(table.read())
    monkeypatch.setattr(BucketTable, "version", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert_changed(rows(spark, [(3, "new", 0.0)]), ["a"])
    monkeypatch.undo()
    assert content(table.read()) == before and len(table.forgotten()) == 1
    table.upsert_changed(rows(spark, [(3, "new", 0.0)]), ["a"])
    assert table.read().where("k = 3").first().a == "new"


def test_the_log_is_compacted(spark, table):
    table.upsert_all(rows(spark, [(1, "z", 1.0)]))
    before, state = content(table.read()), table.state()
    table.compact_log()
    assert content(table.read()) == before and table.state() == state


def test_misuse(spark, table, tmp_path):
    with pytest.raises(ValueError, match="more than once"):
        table.upsert_changed(rows(spark, [(1, "x", 1.0), (1, "y", 1.0)]), ["a"])
    with pytest.raises(ValueError, match="columns differ"):
        table.upsert_all(spark.createDataFrame([(1,)], "k bigint"))
    with pytest.raises(ValueError, match="buckets"):
        BucketTable(spark, table.path, SCHEMA, ["k"], buckets=9).read()
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path), "bucket int", ["bucket"])
    assert BucketTable(spark, str(tmp_path / "none"), SCHEMA, ["k"]).read().count() == 0
