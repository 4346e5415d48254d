"""Members of archives, one partition each, with conditions taken into the source."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from evigraph.sources import archives


def made(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/one.tsv", "a\tb\n1\t2\n3\té\r\n")
        z.writestr("x/two.tsv", "a\tb\n5\t\n")
        z.writestr("other.txt", "\n".join(f"line {i}" for i in range(25_000)))
        z.writestr("empty.txt", "")
    with gzip.open(folder / "b.tsv.gz", "wt") as f:
        f.write("a\tb\n7\t8\n")
    (folder / "c.csv").write_text("no archive")
    return folder


def test_members_are_partitions(spark, tmp_path):
    folder = made(tmp_path)
    rows = archives.read_lines(spark, str(folder))
    assert rows.rdd.getNumPartitions() == 5
    got = {r["member"]: r["n"] for r in rows.groupBy("member").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"x/one.tsv": 3, "x/two.tsv": 2, "other.txt": 25_000, "b.tsv": 2}
    assert [r["line"] for r in rows.where("member = 'x/one.tsv'").orderBy("line_no").collect()] == ["a\tb", "1\t2", "3\té"]
    last = rows.where("member = 'other.txt' AND line_no = 24999").first()
    assert last["line"] == "line 24999" and last["archive"].endswith("a.zip")
    with pytest.raises(Exception, match="nothing"):
        archives.read_lines(spark, str(tmp_path / "nothing")).collect()


def test_conditions_reach_the_source(spark, tmp_path):
    rows = archives.read_lines(spark, f"file://{made(tmp_path)}")
    some = rows.where(F.col("member").endswith(".tsv") & F.col("archive").contains("a.zip") & (F.col("line_no") > 0))
    assert some.rdd.getNumPartitions() == 2 and {r["line"] for r in some.collect()} == {"1\t2", "3\té", "5\t"}
    assert "PythonDataSource" in some._jdf.queryExecution().executedPlan().toString() or "BatchScan" in some._jdf.queryExecution().executedPlan().toString()
    assert rows.where("member = 'none'").count() == 0


def test_tables_of_members(spark, tmp_path):
    folder = made(tmp_path)
    table = archives.read_table(spark, str(folder), ".tsv")
    assert {(r["member"], r["a"], r["b"]) for r in table.collect()} == {("x/one.tsv", "1", "2"), ("x/one.tsv", "3", "é"), ("x/two.tsv", "5", ""), ("b.tsv", "7", "8")}
    with pytest.raises(ValueError):
        archives.read_table(spark, str(folder), ".none")
