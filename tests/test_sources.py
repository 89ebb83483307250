"""Readers and writers on files in a temporary folder."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from capital_access import session
from capital_access.sources import archives, readers, stores
from tests.conftest import rows


def test_fixed_width_and_lines(spark, tmp_path):
    (tmp_path / "a.dat").write_text("AB12 rest\nCD3\n")
    (tmp_path / "b.dat").write_text("EF45\n")
    lines = readers.text_lines(spark, str(tmp_path), with_file=True)
    cut = readers.fixed_width(lines, [("code", 2), ("n", 2)])
    assert rows(cut) == [("a.dat", "AB", "12"), ("a.dat", "CD", "3"), ("b.dat", "EF", "45")]


def test_csv_keeps_zeros_and_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text('code,amount\n00123,"1,000"\n,2\n')
    text = readers.csv_strings(spark, str(tmp_path), ["code", "amount"])
    assert rows(text) == [("", "2"), ("00123", "1,000")]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "y.csv").write_text("code,amount\n7,2.5\n")
    assert rows(readers.csv_typed(spark, str(tmp_path / "y"), "code int, amount double")) == [(7, 2.5)]


def test_csv_binds_columns_by_name_and_keeps_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('race,code,more\n,001,x\nNA,"",y\nWHITE,NA,z\n')
    (tmp_path / "b.csv").write_text("code,race\n002,\n003,BLACK\n")
    (tmp_path / "c.csv").write_text("code\n004\n")
    text = readers.csv_strings(spark, str(tmp_path), ["code", "race"])
    assert rows(text) == [("", None), ("001", ""), ("002", ""), ("003", "BLACK"), ("004", None), (None, "WHITE")]


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "extra": [1]}, {"id": "2"}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"id": "3"}\n{"id": "4", "amt": "5"}\n')
    assert rows(readers.json_records(spark, str(tmp_path / "a.json"), "id string", multi_line=True)) == [("1",), ("2",)]
    assert rows(readers.json_records(spark, str(tmp_path / "b.jsonl"), "id string, amt string")) == [("3", None), ("4", "5")]


def test_zip_members_are_chosen_by_pattern(spark, tmp_path):
    members = {"10.zip": ["exp_aggr.dat"], "12.zip": ["12exp_aggr.dat", "notes.txt"], "16.zip": ["cra2016_Aggr_A11.dat"]}
    for name, inside in members.items():
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member in inside:
                archive.writestr(member, f"{member} 1\r\n{member} 2\n" if member.endswith("dat") else "no\n")
    patterns = [r"^exp_aggr\.dat$", r"^\d\dexp_aggr\.dat$", r"^cra20\d\d_Aggr_A11\.dat$"]
    lines = archives.read_zip_lines(spark, str(tmp_path / "*.zip"), patterns)
    assert rows(lines.select("member", "line_no", "value")) == [
        (m, i, f"{m} {i}") for m in sorted(["12exp_aggr.dat", "cra2016_Aggr_A11.dat", "exp_aggr.dat"]) for i in (1, 2)
    ]
    text = "".join(f"line {k} é" + ("\r\n", "\n", "\r")[k % 3] for k in range(90_000)) + "last"
    with zipfile.ZipFile(tmp_path / "20.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("long.dat", text.encode())
    long = archives.read_zip_lines(spark, str(tmp_path / "20.zip"), ["long"], encoding="utf-8")
    got = [r.value for r in long.orderBy("line_no").collect()]
    assert got == [f"line {k} é" for k in range(90_000)] + ["last"]
    every = archives.read_zip_lines(spark, str(tmp_path / "12.zip"), [r"dat$", r"txt$"], every=True)
    assert every.count() == 3
    with pytest.raises(Exception, match="no member"):
        archives.read_zip_lines(spark, str(tmp_path / "12.zip"), ["absent"]).count()


def test_members_of_an_archive_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as archive:  # stored, so that sizes are those of the texts
        for k in range(6):
            archive.writestr(f"{k}.dat", f"{k}\n" * (2_000 if k < 4 else 10))
        archive.writestr("empty.dat", "")
    whole = archives.read_zip_lines(spark, str(tmp_path / "big.zip"), [r"dat$"], together=1000)
    assert whole.rdd.getNumPartitions() == 5  # the last three are read together
    assert rows(whole.groupBy("member").agg(F.count("*"), F.max("line_no"), F.min("value"))) == [
        (f"{k}.dat", 2_000 if k < 4 else 10, 2_000 if k < 4 else 10, str(k)) for k in range(6)]
    assert archives.read_zip_lines(spark, str(tmp_path / "big.zip"), [r"dat$"]).rdd.getNumPartitions() == 1
    assert archives.read_zip_lines(spark, str(tmp_path / "big.zip"), [r"^4"]).count() == 10


def test_broken_directory_and_odd_names(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "odd name é%20.zip", "w") as archive:
        archive.writestr("a.dat", "1\n2\n")
    assert archives.read_zip_lines(spark, str(tmp_path), ["a"]).count() == 2
    content = (tmp_path / "odd name é%20.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(content[:-30])
    with pytest.raises(Exception, match="cut.zip has no readable directory"):
        archives.read_zip_lines(spark, str(tmp_path / "cut.zip"), ["a"]).count()


def test_archive_in_a_store_of_spark_alone(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("a.dat", "1\n2\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("\n\ncode,a\n1,2\n")
    (tmp_path / "c" / "y.csv").write_text("a,code\n3,4\n")
    monkeypatch.setattr(archives, "reachable", lambda path: False)
    monkeypatch.setattr(readers, "reachable", lambda path: False)
    assert archives.read_zip_lines(spark, str(tmp_path / "a.zip"), ["a"]).count() == 2
    assert rows(readers.csv_strings(spark, str(tmp_path / "c"), ["code", "a"])) == [("1", "2"), ("4", "3")]


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for k in range(n):
            header = ["code,race", "race,code", "code"][k % 3]
            (folder / f"{k:04d}.csv").write_text(f"{header}\n" + ",".join({"code": f"{k:03d}", "race": "W"}[c] for c in header.split(",")) + "\n")
        spark.sparkContext.setJobGroup(f"headers {n}", "")
        read = readers.csv_strings(spark, str(folder), ["code", "race"])
        started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {n}"))
        spark.sparkContext.setJobGroup("other", "")
        assert rows(read) == sorted(((f"{k:03d}", None if k % 3 == 2 else "W") for k in range(n)), key=str)
        return started

    # Spark lists the files of a header by a job of its own where they are many.
    assert jobs(200) <= jobs(40) + 3 <= 10


def test_header_names():
    assert readers.header_names('a,,"b, c",A,d') == ["a0", "_c1", "b, c", "A3", "d"]


def test_bundle_keeps_only_matching_names(spark, tmp_path):
    facts = spark.createDataFrame([(2014, "a"), (2015, "b")], "year int, `odd name` string")
    names = stores.save_bundle(
        spark, {"facts_cleaned": facts, "areas_cleaned": facts.drop("year"), "draft": facts}, str(tmp_path / "b"),
        "_cleaned", {"facts_cleaned": ["year"]},
    )
    assert names == ["facts_cleaned", "areas_cleaned"]
    back = stores.load_bundle(spark, str(tmp_path / "b"), "facts", views=True)
    assert list(back) == ["facts_cleaned"] and back["facts_cleaned"].columns == ["year", "odd name"]
    assert rows(spark.table("facts_cleaned")) == [(2014, "a"), (2015, "b")]
    path = stores.bundle_tables(spark, str(tmp_path / "b"))[0]["path"]
    assert os.path.isdir(f"{path}/year=2014")
    assert rows(readers.yearly_parquet(spark, path, [2015]).select("year")) == [(2015,)]


def test_bundle_versions(spark, tmp_path):
    root = str(tmp_path / "b")
    with pytest.raises(ValueError, match="no bundle at"):
        stores.load_bundle(spark, root)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    stores.save_bundle(spark, {"x": first, "y": first}, root)
    back = stores.load_bundle(spark, root)
    # Saved over its own source.
    stores.save_bundle(spark, {"x": back["x"].where("k = 1"), "y": back["y"]}, root)
    assert rows(stores.load_bundle(spark, root)["x"]) == [(1, "a")] and rows(back["x"]) == [(1, "a"), (2, "b")]
    # A failure between tables.
    bad = first.select("k", F.raise_error(F.lit("stop")).cast("string").alias("v"))
    with pytest.raises(Exception, match="stop"):
        stores.save_bundle(spark, {"x": first.where("false"), "y": bad}, root)
    now = stores.load_bundle(spark, root)
    assert rows(now["x"]) == [(1, "a")] and rows(now["y"]) == [(1, "a"), (2, "b")]
    assert rows(stores.load_bundle(spark, root, version=1)["x"]) == [(1, "a"), (2, "b")]
    assert stores.save_bundle(spark, {}, root) == [] and stores.load_bundle(spark, root) == {}
    with pytest.raises(ValueError, match="of version 9"):
        stores.load_bundle(spark, root, version=9)


def test_report_and_csv(spark, tmp_path):
    summary = spark.createDataFrame([("a", 1.5), (None, None)], "k string, v double")
    manifest = stores.save_report(spark, {"x_summary": summary, "y": summary}, str(tmp_path / "r"))
    assert [(r["name"], r["n_columns"], r["n_rows"]) for r in manifest.collect()] == [("x_summary", 2, 2)]
    assert rows(readers.csv_typed(spark, str(tmp_path / "r" / "x_summary"), "k string, v double")) == [("a", 1.5), (None, None)]


class Cluster:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, folder=None, warehouse="hdfs:///warehouse/", master="yarn"):
        self.conf = {"spark.sql.warehouse.dir": warehouse, "spark.master": master} | ({"spark.checkpoint.dir": folder} if folder else {})


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(Cluster("hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(Cluster("/shared"), "x").startswith("/shared/capital_access/x-")
    assert session.shared_dir(Cluster()) == "hdfs:///warehouse/scratch"
    assert session.shared_dir(Cluster(warehouse="file:/w", master="local[8]")) == "file:/w/scratch"
    assert session.shared_dir(Cluster("file:/shared", "file:/w")) == "file:/shared"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="share no folder"):
            session.shared_dir(Cluster(warehouse=warehouse))


def test_settled_table_is_read_from_the_shared_folder(spark):
    settled = session.settle(spark.createDataFrame([(1, "a b"), (2, "")], "`odd col` int, s string").filter(F.col("s") > "a"))
    assert rows(settled) == [(1, "a b")]
    assert session.shared_dir(spark) in settled.inputFiles()[0]
