import pytest
from oracle import check

from quillon.plans import library


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_matches_duckdb(spark, sf, name):
    check(spark, library.QUERIES[name], library.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_runs_and_repeats(spark, sf, name):
    first, second = (sorted(map(repr, library.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 3


def test_resampling_queries_take_the_reference_draws(spark, sf, monkeypatch):
    import inspect

    from quillon.operators import resample
    from quillon.plans import inference

    want = {
        "pooled_stats": ("pooled_stats", {"bootstraps": 10_000, "permutations": 5_000}),
        "paired_bootstrap": ("paired_bootstrap", {"draws": 10_000}),
        "cluster_bootstrap": ("cluster_bootstrap", {"draws": 2_000}),
        "within_subject_perm": ("within_subject_permutation", {"draws": 5_000}),
        "changepoint_perm": ("changepoint_permutation", {"draws": 200}),
    }
    defaults = {k: v.default for k, v in inspect.signature(resample.pooled).parameters.items()}
    for query, (operator, draws) in want.items():
        signature, taken = inspect.signature(getattr(resample, operator)), {}
        with monkeypatch.context() as m:
            m.setattr(resample, operator, lambda *a, signature=signature, taken=taken, **k: taken.update(signature.bind(*a, **k).arguments))
            getattr(inference, query)(spark, sf)
        options = {**defaults, **{k: v.default for k, v in signature.parameters.items()}, **taken, **taken.get("options", {})}
        assert {k: options[k] for k in draws} == draws
