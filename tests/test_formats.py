import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.schemas import CHANNELS
from quillon.sources import decoders, formats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    rng = np.random.default_rng(0)
    signals = {"long": rng.normal(0, 20e-6, (3, 250 * 400)), "short": rng.normal(0, 20e-6, (3, 250 * 7))}
    for name, x in signals.items():
        (root / f"{name}.edf").write_bytes(decoders.write_edf([("EEG Fp1-Ref", x[0]), ("O1", x[1]), ("X1", x[2])], 250))
    (root / "sub").mkdir()
    (root / "sub" / "broken.EDF").write_bytes(b"broken")
    (root / "cut.edf").write_bytes((root / "short.edf").read_bytes()[:-300])
    (root / "empty.edf").write_bytes(b"")
    formats.register(spark)
    return root, signals


def joined(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.channel, r.start)):
        assert r.start == len(by.setdefault(r.channel, []))
        by[r.channel] += r.samples
    return by


@pytest.mark.parametrize("split", [64_000, 1_001, 10**9])
def test_ranges_make_the_whole_recording(spark, folder, split):
    root, signals = folder
    df = spark.read.format("edf").option("split_bytes", split).option("block_records", 3).load(str(root))
    size = (root / "long.edf").stat().st_size
    assert df.rdd.getNumPartitions() >= size // split
    rows = df.collect()
    for name in ("long", "short"):
        mine = [r for r in rows if r.path.endswith(f"/{name}.edf")]
        assert {r.sfreq for r in mine} == {250.0} and all(r.error is None for r in mine)
        got = joined(mine)
        assert list(got) == ["Fp1", "O1"] and all(np.abs(np.array(got[c]) - signals[name][i]).max() < 5e-9 for i, c in enumerate(got))
        whole = {c: x for c, _, x in decoders.edf((root / f"{name}.edf").read_bytes())}
        assert all(np.allclose(got[c], whole[c], atol=1e-15) for c in got)
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error}
    assert set(errors) == {"broken.EDF", "cut.edf", "empty.edf"} and errors["cut.edf"] == "cut off: 6 of 7 records"
    assert len(joined([r for r in rows if r.path.endswith("/cut.edf") and not r.error])["O1"]) == 6 * 250
    # one partition of the long file is one task's work
    if split == 64_000:
        tasks = df.filter("path LIKE '%long.edf'").select(F.spark_partition_id()).distinct().count()
        assert tasks >= 5


def test_channels_are_pruned(spark, folder, monkeypatch):
    root, _ = folder
    one = spark.read.format("edf").option("channels", "O1").load(str(root / "short.edf"))
    assert {r.channel for r in one.collect()} == {"O1"}
    pushed = spark.read.format("edf").load(str(root / "short.edf")).filter("channel IN ('O1', 'P3')")
    assert {r.channel for r in pushed.collect()} == {"O1"}
    reader = formats.EdfReader({"path": str(root / "short.edf")})
    list(reader.pushFilters([formats.In(("channel",), ("O1", "P3")), formats.EqualTo(("channel",), "O1")]))
    assert reader.channels == {"O1"}
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {c for b in batches for c in b.column("channel").to_pylist()} == {"O1"}


def test_wide_layout_takes_its_columns_from_the_header(spark, folder):
    root, signals = folder
    df = spark.read.format("edf").option("layout", "wide").option("block_records", 2).load(str(root / "short.edf"))
    assert df.columns == ["path", "start_s", "Fp1", "O1", "error"]
    rows = sorted(df.collect(), key=lambda r: r.start_s)
    assert [r.start_s for r in rows] == [0.0, 2.0, 4.0, 6.0]
    assert np.abs(np.concatenate([r.O1 for r in rows]) - signals["short"][1]).max() < 5e-9
    mixed = spark.read.format("edf").option("layout", "wide").load(str(root)).filter("error IS NOT NULL")
    assert mixed.count() == 3


def test_a_missing_path_is_an_error(spark, folder):
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("edf").load(str(folder[0] / "nowhere")).collect()


def test_matrices(spark, tmp_path):
    formats.register(spark)
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (1000, 19)).astype(np.int16)
    plain = decoders.write_mat("v1p", x)
    import struct
    import zlib

    packed = zlib.compress(plain[128:])
    (tmp_path / "plain.mat").write_bytes(plain)
    (tmp_path / "packed.mat").write_bytes(plain[:128] + struct.pack("<II", 15, len(packed)) + packed)
    (tmp_path / "real.mat").write_bytes(decoders.write_mat("v2p", x.astype(float)))
    (tmp_path / "narrow.mat").write_bytes(decoders.write_mat("v3p", x[:, :5].copy()))
    (tmp_path / "broken.mat").write_bytes(b"no matrix")
    (tmp_path / "cut.mat").write_bytes(plain[:-100])
    rows = spark.read.format("mat").option("block_records", 2).load(str(tmp_path)).collect()
    for name in ("plain", "packed", "real"):
        got = joined([r for r in rows if r.path.endswith(f"/{name}.mat")])
        assert list(got) == sorted(CHANNELS) and all(np.allclose(got[c], x[:, i] * 1e-6, atol=1e-18) for i, c in enumerate(CHANNELS))
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"narrow.mat", "broken.mat", "cut.mat"}
    few = spark.read.format("mat").load(str(tmp_path / "plain.mat")).filter("channel = 'O1'").collect()
    assert {r.channel for r in few} == {"O1"}


def test_archives(spark, tmp_path):
    formats.register(spark)
    rng = np.random.default_rng(2)
    held = {c: rng.normal(0, 1, (3, 3)) for c in ("ec", "eo")}
    np.savez(tmp_path / "a.npz", **held)
    np.savez_compressed(tmp_path / "b.npz", ec=np.arange(4), text=np.array(["x"]))
    (tmp_path / "c.npz").write_bytes(b"PK broken")
    (tmp_path / "d.npz").write_bytes(b"")
    rows = spark.read.format("npz").load(str(tmp_path)).collect()
    by = {(r.path.rsplit("/", 1)[1], r.name): r for r in rows if r.error is None}
    assert set(by) == {("a.npz", "ec"), ("a.npz", "eo"), ("b.npz", "ec")} and all(by["a.npz", c].values == held[c].ravel().tolist() for c in held)
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"b.npz", "c.npz", "d.npz"} and by["a.npz", "ec"].shape == [3, 3]
    assert {r.name for r in spark.read.format("npz").option("arrays", "eo").load(str(tmp_path / "a.npz")).collect()} == {"eo"}
