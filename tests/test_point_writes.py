"""Point updates rewrite the files they touch, survive a lost driver, and show every row once."""

import glob
import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from crestline.sources import sinks


def files(path):
    return {f: os.stat(f).st_ino for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "status", "error").collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "a table")
    df = spark.range(1000).select("id", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error"))
    df.repartitionByRange(100, "id").write.parquet(path)
    return path


def test_one_row_rewrites_one_file_of_a_hundred(spark, table):
    before = files(table)
    assert len(before) == 100
    assert sinks.update_table(spark, table, spark.createDataFrame([(77, "DONE"), (5000, "DONE")], "id long, status string"), "id") == 1
    after = files(table)
    assert set(after) == set(before) and sum(after[f] != before[f] for f in before) == 1
    assert rows(spark, table) == sorted((i, "DONE" if i == 77 else "PENDING", None) for i in range(1000))
    assert sinks.update_table(spark, table, spark.createDataFrame([(None, "DONE"), (5000, "DONE")], "id long, status string"), "id") == 0
    assert not glob.glob(f"{table}/_update*")


def test_conditional_updates(spark, table):
    assert 1 <= sinks.update_rows(spark, table, F.col("id").between(100, 104), {"status": F.lit("CANCELLED"), "error": F.lit("x")}) <= 2
    assert rows(spark, table) == sorted((i, "CANCELLED", "x") if 100 <= i <= 104 else (i, "PENDING", None) for i in range(1000))


def test_new_rows_are_new_files(spark, table):
    before = files(table)
    new = spark.createDataFrame([(1, "AGAIN", None), (2000, "NEW", None), (2000, "NEW", None)], "id long, status string, error string")
    for _ in range(2):
        sinks.insert_new(spark, table, new, "id")
    after = files(table)
    assert all(after[f] == before[f] for f in before)
    assert rows(spark, table) == sorted([(i, "PENDING", None) for i in range(1000)] + [(2000, "NEW", None)])


def test_a_lost_driver_leaves_every_row_once_and_the_rest_is_made_up_for(spark, table, monkeypatch):
    """The driver is lost once all is written, but nothing moved; then with some files moved; then before all is written."""
    update = spark.createDataFrame([(i, "DONE") for i in (5, 505, 905)], "id long, status string")
    real, calls = sinks.finish_updates, []

    def lost(s, p):
        calls.append(p)
        if len(calls) % 2 == 0:
            raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "finish_updates", lost)
    with pytest.raises(KeyboardInterrupt):
        sinks.update_table(spark, table, update, "id")
    assert rows(spark, table) == [(i, "PENDING", None) for i in range(1000)]
    (left,) = glob.glob(f"{table}/_update-*")
    old = json.load(open(f"{left}/_files.json"))
    assert len(old) == 3
    (one,) = glob.glob(f"{left}/_i=0/*.parquet")
    os.replace(one, unquote(old[0].removeprefix("file://").removeprefix("file:")))  # the first file was moved before the end
    for crc in glob.glob(f"{table}/.*.crc"):
        os.remove(crc)
    spark.catalog.refreshByPath(table)
    half = rows(spark, table)
    assert len(half) == 1000 and sum(r[1] == "DONE" for r in half) == 1
    real(spark, table)
    spark.catalog.refreshByPath(table)
    assert [r[0] for r in rows(spark, table) if r[1] == "DONE"] == [5, 505, 905] and len(rows(spark, table)) == 1000
    os.makedirs(f"{table}/_update-half/_i=0")  # no manifest: it never counted
    real(spark, table)
    assert not glob.glob(f"{table}/_update*") and len(rows(spark, table)) == 1000


def test_partitioned_tables(spark, tmp_path):
    path = str(tmp_path / "jobs")
    df = spark.range(40).select("id", F.lit("P").alias("status"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("u/ä "), (F.col("id") % 4).cast("string")).alias("owner"))
    df.repartition(2).write.partitionBy("owner").parquet(path)
    before = files(path)
    assert sinks.update_table(spark, path, spark.createDataFrame([(6, "DONE")], "id long, status string"), "id") == 1
    sinks.insert_new(spark, path, spark.createDataFrame([(99, "N", None, "new")], "id long, status string, error string, owner string"), "id")
    got = {r["id"]: (r["status"], r["owner"]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 41 and got[6] == ("DONE", "u/ä 2") and got[99] == ("N", "new") and got[7] == ("P", "u/ä 3")
    assert sum(files(path).get(f) != n for f, n in before.items()) == 1
    with pytest.raises(ValueError):
        sinks.update_table(spark, path, spark.createDataFrame([(6, "x")], "id long, owner string"), "id")
