import pytest

from quillon.operators import merge, tables


def test_stems_have_every_suffix():
    columns = ["tbr_ec", "tbr_eo", "iaf_ec", "_ec", "x_eo", "id", "a_ec_ec", "a_ec_eo"]
    assert tables.stems(columns, ["_ec", "_eo"]) == ["tbr", "a_ec"]
    assert tables.stems(columns, ["_vcpt"]) == []


def test_rows_with_any_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, None), (2, nan, None), (3, nan, "x"), (4, None, None)], "id long, a double, `b.c` string")
    assert {r.id for r in tables.any_value(df, ["a", "b.c"]).collect()} == {1, 3}
    assert tables.any_value(df, []).count() == 0


def test_columns_become_conditions(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 9.0), (2, None, 3.0, 9.0)], "id long, a_ec double, a_eo double, b_ec double")
    out = tables.by_condition(df, ["id"], {"_ec": "EC", "_eo": "EO"})
    assert out.columns == ["id", "condition", "a"] and {tuple(r) for r in out.collect()} == {(1, "EC", 1.0), (1, "EO", 2.0), (2, "EO", 3.0)}


def test_backups_are_copies_and_best_effort(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert not merge.backup(spark, path, "fold_0")
    merge.save(path, spark.createDataFrame([(1, "a")], "k long, v string"), "k")
    assert merge.backup(spark, path, "fold_0")
    merge.save(path, spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), "k")
    assert [tuple(r) for r in spark.read.parquet(f"{path}.fold_0").collect()] == [(1, "a")]
    assert merge.backup(spark, path, "fold_0") and spark.read.parquet(f"{path}.fold_0").count() == 2
    assert not merge.backup(spark, "nofs://x/y", "z")


def test_robust_scale_of_ties_and_groups(spark):
    rows = [("a", float(v)) for v in (-5, 1, 2, 3, 4)] + [("b", 1.0)] * 40 + [("b", -9.0)] * 2 + [("c", 7.0), ("d", None)]
    got = {r.g: r.scale for r in tables.robust_scale(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    want = {g: sorted(abs(v) for k, v in rows if k == g and v is not None) for g in "abc"}
    assert got == {g: pytest.approx(v[int(len(v) * 0.95)]) for g, v in want.items()}
