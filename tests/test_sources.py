import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.schemas import BOUNDARIES, CHANNELS
from quillon.sources import decoders, readers, sinks
from quillon.streaming import live


def test_edf_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 20e-6, (2, 1000))
    data = decoders.write_edf([("Fp1", a), ("O1", b), ("X1", b)], 500)
    found = decoders.edf(data)
    assert [(c, fs) for c, fs, _ in found] == [("Fp1", 500.0), ("O1", 500.0)]
    assert np.abs(found[0][2] - a).max() < 5e-9
    (tmp_path / "F001-20240101-120000-EOEC.edf").write_bytes(data)
    (tmp_path / "F001-20240101-130000-VCPT.EDF").write_bytes(data)
    (tmp_path / "M002-20240101-120000-EOEC.edf").write_bytes(b"broken")
    (tmp_path / "notes.edf").write_bytes(b"x")
    rows = readers.recordings(spark, str(tmp_path)).collect()
    assert sum(r.signal is not None for r in rows) == 4 and sum(r.signal is None for r in rows) == 2
    subjects = readers.discover(spark, str(tmp_path)).orderBy("subject_id").collect()
    assert [(r.subject_id, r.group, r.vcpt_path is None) for r in subjects] == [("F001", "ADHD", False), ("M002", "Control", True)]
    assert [r.path.rsplit("/", 1)[1] for r in readers.near_misses(spark, str(tmp_path)).collect()] == ["notes.edf"]
    (tmp_path / "F001-20240102-120000-EOEC.edf").write_bytes(data)
    with pytest.raises(Exception, match="two rest recordings"):
        readers.discover(spark, str(tmp_path)).collect()


def test_mat_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.integers(-500, 500, (256, 19)).astype(np.int16)
    for group, name, values in (("ADHD_part1", "v1p", x), ("Control_part2", "v2p", x.astype(float))):
        (tmp_path / group).mkdir()
        (tmp_path / group / f"{name}.mat").write_bytes(decoders.write_mat(name, values))
    rows = readers.matrices(spark, str(tmp_path)).collect()
    by = {(r.path.rsplit("/", 2)[1], r.channel): r.signal for r in rows}
    assert len(by) == 38 and np.allclose(by["ADHD_part1", CHANNELS[3]], x[:, 3] * 1e-6) and by["ADHD_part1", "O2"] == by["Control_part2", "O2"]
    assert {(r.subject_id, r.group) for r in readers.discover_folders(spark, str(tmp_path)).collect()} == {("v1p", "ADHD"), ("v2p", "Control")}


def test_file_names(spark):
    df = spark.createDataFrame([("/x/f12.20240101_0900-eoec.EDF",), ("/x/bad.edf",)], "path string")
    assert [r.n and tuple(r.n) for r in df.select(readers.parse_name(F.col("path"), strict=False).alias("n")).collect()] == [("F12", "ADHD", "20240101", "0900", "EOEC"), None]
    with pytest.raises(Exception, match="unexpected file name"):
        df.select(readers.parse_name(F.col("path"))).collect()


def test_csv_is_strict_and_trusted_rows_parse(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("subject_id,boundary_frac,trusted\na,0.5,True\nb,x,1\nc,0.4,false\nd,0.6, TRUE\n")
    rows = readers.trusted(readers.csv(spark, str(path), BOUNDARIES)).collect()
    assert {(r.subject_id, r.boundary_frac) for r in rows} == {("a", 0.5), ("d", 0.6)}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_log_lines_sniff_their_encoding(spark, tmp_path, encoding):
    path = tmp_path / "run.log"
    path.write_bytes("starting\n[ok] S001: 12 epochs\n[ok] S002: 7 epochs\n".encode(encoding))
    rows = readers.log_lines(spark, str(path), r"\[(\w+)\] (S\d+): (\d+) epochs", ["status", "subject_id", "n"]).collect()
    assert {tuple(r) for r in rows} == {("ok", "S001", "12"), ("ok", "S002", "7")}


def test_paths_resolve_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([("a/b.edf",), ("/abs/c.edf",), (None,)], "p string")
    out = df.select(readers.absolute(F.col("p"), "/root/d/").alias("p"))
    assert [r.p for r in out.collect()] == ["/root/d/a/b.edf", "/abs/c.edf", None]
    assert [r.p for r in out.select(readers.relative(F.col("p"), "/root/d").alias("p")).collect()] == ["a/b.edf", "/abs/c.edf", None]
    monkeypatch.delenv("QUILLON_DATA_ROOT", raising=False)
    with pytest.raises(ValueError):
        readers.data_root(None)
    assert readers.synthetic_subjects(spark).groupBy("group").count().count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "img", "fold_0", "ADHD", bytearray(b"x"))], "subject_id string, representation string, split string, label string, image binary")
    sinks.write_images(df, str(tmp_path / "images"))
    back = spark.read.parquet(str(tmp_path / "images"))
    assert back.filter("split = 'fold_0'").count() == 1
    text = sinks.to_json(spark.createDataFrame([(1, float("nan"))], "a int, b double")).first().json
    assert json.loads(text) == {"a": 1, "b": None}
    sinks.write_csv(df.drop("image"), str(tmp_path / "csv"))
    sinks.write_csv(df.drop("image"), str(tmp_path / "csv"), append=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_streams_match_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.landing(spark, str(tmp_path / "in"), events.schema)
    q = live.rejection_rates(stream, 60).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = live.rejection_rates(events, 60)
    same = lambda d: sorted((str(r.start), r.event_type, r.n, round(r.rate, 9)) for r in d.collect())
    assert same(spark.table("rates")) == same(batch)
    q = live.running_means(stream).writeStream.format("memory").queryName("means").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {r.user_id: (r.n, round(r.mean, 6)) for r in spark.table("means").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("mean", "n").alias("mean")).collect()}
    want = {r.user_id: (r.n, round(r.m, 6)) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
    assert last == want
    assert live.sessions(events).count() > 0


def test_settings_of_runs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("task: classify\r\nfliplr: 0.0\nhsv_h: 0.015 # jitter\nname: 'x: y'\ndata: C:\\\\x\nnone: ~\nlist:\n  - 1\nfliplr: 0.5\n")
    found = {r.key: r.value for r in readers.setting_files(spark, str(tmp_path)).collect()}
    assert found == {"task": "classify", "fliplr": "0.5", "hsv_h": "0.015", "name": "x: y", "data": "C:\\\\x", "none": None, "list": None}
    faults = readers.setting_faults(readers.setting_files(spark, str(tmp_path)), {"fliplr": "0", "hsv_h": ".015", "task": "CLASSIFY", "mosaic": "0", "none": "0"}).collect()
    assert {(r.key, r.fault, r.got) for r in faults} == {("fliplr", "wrong", "0.5"), ("mosaic", "absent", None), ("none", "wrong", None)}
