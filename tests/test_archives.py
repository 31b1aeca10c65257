"""ZIP members as partitions, and outputs that one pass commits together."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallywright.sources.archives import archives_at, outputs_of, register


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def load(spark, path, **options):
    return register(spark).read.format("zipped_text").options(path=str(path), **options).load()


def test_members_are_tasks(spark, tmp_path):
    long = "y" * 300_000
    archive(tmp_path / "a.zip", {"1.tsv": "a\tb\tc\n1\t\"x\t\n2\té\t" + long + "\n", "2.tsv": "c\ta\tb\nz\t3\t\n", "skipped.txt": "no"})
    archive(tmp_path / "b.zip", {"1.tsv": "a\tb\tc\n"})
    df = load(spark, tmp_path)
    assert df.columns == ["a", "b", "c"] and df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [("1", '"x', None), ("2", "é", long), ("3", None, "z")]
    some = load(spark, tmp_path / "a.zip", columns="c,a")
    assert sorted(map(tuple, some.select("c", F.col("a").cast("int")).collect()), key=repr) == sorted([(None, 1), (long, 2), ("z", 3)], key=repr)


def test_headers_are_checked_when_planned(spark, tmp_path):
    archive(tmp_path / "a.zip", {"1.tsv": "a\tb\n1\t2\n", "2.tsv": "a\tx\n1\t2\n"})
    with pytest.raises(Exception, match="2 different headers"):
        load(spark, tmp_path)
    archive(tmp_path / "a.zip", {"1.tsv": "a\tb\n1\t2\n"})
    with pytest.raises(Exception, match="lack z"):
        load(spark, tmp_path, columns="a,z")


def test_archives_are_written_by_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), "id")).alias("v")).repartition(3)
    register(spark)
    df.write.format("zipped_text").option("path", path).option("rows", 100).mode("append").save()
    assert len(archives_at(path)) == 3 and not [x for x in os.listdir(path) if x.startswith("_")]
    back = load(spark, path)
    assert back.rdd.getNumPartitions() >= 12
    assert sorted((int(r["id"]), r["v"]) for r in back.collect()) == sorted(map(tuple, df.collect()))
    bad = spark.createDataFrame([("a\tb",)], "v string")
    with pytest.raises(Exception, match="separator"):
        bad.write.format("zipped_text").option("path", path).mode("append").save()
    assert len(archives_at(path)) == 3 and not [x for x in os.listdir(path) if x.startswith("_")]


def test_outputs_of_one_pass(spark, tmp_path):
    path = str(tmp_path / "out")
    register(spark)
    df = spark.range(500).select("id", F.when(F.col("id") % 5 == 0, "no").otherwise("yes").alias("to"), F.lit("x").alias("v")).repartition(4)
    df.write.format("split_parquet").options(path=path, by="to", outputs="yes,no,none").mode("append").save()
    assert outputs_of(path) == {"yes": 400, "no": 100, "none": 0} and sorted(os.listdir(path)) == ["_outputs.json", "no", "none", "yes"]
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/no").collect()) == list(range(0, 500, 5))
    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="no output is named"):
        df.write.format("split_parquet").options(path=other, by="to", outputs="yes").mode("append").save()
    with pytest.raises(FileNotFoundError):
        outputs_of(other)
    assert not [x for x in (os.listdir(other) if os.path.isdir(other) else []) if x != "_outputs.json"]
