"""Readers, writers and streams on small files."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers, writers
from sparkloom.streaming import steps


def test_jsonl(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n[1]\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(tmp_path / "good.jsonl"), "a int").collect()) == [1, 2]
    assert [r.a for r in readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed|not an object"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_aliases(spark):
    rows = spark.createDataFrame([("", "p", 3), ("q", None, 4)], "question string, prompt string, source_id int")
    out = readers.aliased(rows, {"question": ["question", "prompt"], "id": ["id", "source_id"], "none": ["x"]}).collect()
    assert [tuple(r) for r in out] == [("p", "3", None), ("q", "4", None)]


def test_question_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("what is 1+1\n2\nwhat is 2+2\n4\n")
    assert [(r.question, r.answer) for r in readers.question_pairs(spark, str(tmp_path / "m.txt")).orderBy("number").collect()] == [("what is 1+1", "2"), ("what is 2+2", "4")]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "m.txt", "train/m.txt")
    assert [(r.member, r.answer) for r in readers.tar_questions(spark, str(tmp_path / "a.tar.gz")).orderBy("number").collect()] == [("train/m.txt", "2"), ("train/m.txt", "4")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n")
    (tmp_path / "b.csv").write_text("x,y,z\n4,5,6\n7,8")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    paths = [str(tmp_path / f) for f in ("a.csv", "b.csv", "c.csv")]
    assert readers.csv_columns(spark, paths[0], ["x", "z"]).columns == ["x", "z"]
    assert readers.csv_columns(spark, paths[1], ["x"], "x int, y int, z int", torn=True).count() == 1
    with pytest.raises(ValueError, match="missing"):
        readers.csv_columns(spark, paths[0], ["nope"])
    assert readers.same_header_csv(spark, paths[:1]).count() == 1
    with pytest.raises(ValueError, match="headers"):
        readers.same_header_csv(spark, paths)


def test_experiments_and_configs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("exp_name,alpha,enabled\na,1,true\nb,2,false\nc,3,\n")
    assert [(r.record, r.exp_name) for r in readers.experiments(spark, str(tmp_path / "e.csv"), ["exp_name"]).orderBy("record").collect()] == [(1, "a"), (3, "c")]
    (tmp_path / "root/exp/v1").mkdir(parents=True)
    (tmp_path / "root/exp/v1/config.json").write_text('{"lr": 0.1}')
    (tmp_path / "root/exp/v2").mkdir(parents=True)
    (tmp_path / "root/exp/v2/config.json").write_text("{broken")
    found = readers.discovered(spark, str(tmp_path / "root"))
    assert sorted((r.experiment, r.version) for r in found.collect()) == [("exp", "v1"), ("exp", "v2")]
    configs = readers.tolerant_config(spark, f"{tmp_path}/root/*/*/config.json")
    assert sorted(str(r[0]) for r in configs.select(F.expr("try_variant_get(config, '$.lr', 'double')")).collect()) == ["0.1", "None"]


def test_logs(spark, tmp_path):
    (tmp_path / "train.log").write_text("start\n 1%|  | 5/100 [00:01<\n{'loss': 0.5, 'note': 'x', 'bad': float}\n{'loss': 0.25, 'entropy': 1.0, 'inf': 1e999}\n 2%|  | 10/100 [00:02<\rrest {'loss': 2}\n")
    got = [(r.line, r.step, r.total, r.metrics) for r in readers.log_steps(spark, str(tmp_path / "train.log")).orderBy("line").collect()]
    assert got == [(3, 5, 100, {"loss": 0.25, "entropy": 1.0}), (5, 10, 100, {"loss": 2.0})]


def test_splits_refuse_to_overwrite(spark, tmp_path):
    root = str(tmp_path / "data")
    parts = {"train": spark.range(3), "eval": spark.range(1)}
    writers.save_splits(parts, root)
    with pytest.raises(FileExistsError):
        writers.save_splits(parts, root)
    writers.save_splits({"train": spark.range(5)}, root, overwrite=True)
    assert spark.read.parquet(f"{root}/train").count() == 5 and not list((tmp_path / "data").glob(".new*"))
    assert readers.dataset(spark, str(tmp_path), "data", "eval").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.dataset(spark, str(tmp_path), "nothing", "eval")


def test_unified_and_upsert(spark, tmp_path):
    writers.write_unified({"runs": spark.createDataFrame([(1,)], "a int"), "steps": spark.createDataFrame([("x",)], "b string")}, str(tmp_path / "u"))
    assert readers.table_rows(spark, str(tmp_path / "u"), "runs").select("a").first().a == 1
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted((r.k, r.v) for r in writers.upserted(old, new, ["k"]).collect()) == [(1, "o"), (2, "n"), (3, "n")]
    writers.write_union_csv(spark.createDataFrame([(1, 2, 3)], "z int, run int, a int"), str(tmp_path / "c"), ["run"], "gzip")
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["run", "a", "z"]
    writers.append_history(spark, [{"a": "1"}], str(tmp_path / "h"), ["a", "b"])
    writers.append_jsonl(spark.range(2), str(tmp_path / "j"))
    writers.export_matches(spark.range(1).withColumn("_index", F.lit(7)), str(tmp_path / "x"))
    assert [json.loads(f.read_text()) for f in (tmp_path / "x").glob("*.json") if f.stat().st_size] == [{"_index": 7, "id": 0}]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = steps.step_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "), 1)
    out = steps.windowed_means(stream, "ts", ["event_type"], "value")
    q = out.writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): (r.n, round(r.mean, 9)) for r in spark.table("means").collect()}
    want = {(r.start, r.event_type): (r.n, round(r.mean, 9)) for r in steps.windowed_means(events, "ts", ["event_type"], "value").collect()}
    assert got == want
    once = steps.step_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "), 1)
    steps.upsert_into(once.select("user_id", "value"), str(tmp_path / "out"), ["user_id"], str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "out").glob("v*"), key=lambda p: int(p.name[1:]))
    assert spark.read.parquet(str(last)).count() == events.select("user_id").distinct().count()
