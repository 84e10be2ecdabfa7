"""Steps whose work must not gather a cross-section, a month or a study in one task."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog

from .conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["rank_normal_v1", "rank_normal_v2", "neutralize_b", "neutralize_b1", "neutralize_b2", "neutralize_e"])
def test_cross_sections_move_no_rows(spark, name):
    """Rows meet tables of their cross-sections: no window and no sort of the rows."""
    found = plan(catalog.queries()[name](spark, SMALL))
    assert "Window" not in found and "Sort " not in found


def test_months_of_the_overlay_move_no_rows(spark):
    """The overlay's input meets a row a month; it isn't sorted by month."""
    from tessera.plans.strategy import _overlay_input

    found = plan(_overlay_input(spark, SMALL))
    assert "Window" not in found and "Exchange hashpartitioning(month_idx" not in found


def test_best_rows_are_cut_before_they_move(spark):
    """The rank of a portfolio's rows is limited within each task before the shuffle."""
    assert "WindowGroupLimit" in plan(catalog.queries()["build_portfolio"](spark, SMALL))


def test_quarters_of_statements_are_read_once(spark):
    from tessera.plans.fundamentals import statements

    found = statements(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert found.count("Scan parquet") == 1 and "Join" not in found


def test_distinct_keys_of_windows_are_counted_beside_the_rows(spark):
    """Rows in windows go into sums at once; a distinct count would shuffle every copy."""
    df = spark.createDataFrame([(e, m, float(e * m)) for e in range(50) for m in range(49)] + [(None, 0, 1.0)], "entity long, month_idx int, close double")
    from tessera.operators import portfolio, sketches

    windows = portfolio.rolling_windows(df)
    found = sketches.estimates(sketches.merged(sketches.month_states(df, ["close"]), windows, ["close"]), ["close"])
    out = sketches.within_bounds(df, windows, found, ["close"])
    assert "count(distinct" not in plan(out)
    assert {(r.split, r.rows, r.keys_ok, r.quantiles_ok) for r in out.collect()} == {("train", 1801, True, True), ("valid", 600, True, True), ("test", 50, True, True)}


@pytest.mark.parametrize("name", ["study_param_ranges", "study_convergence", "study_advice", "study_verdict"])
def test_studies_are_stored_before_they_are_searched(spark, name):
    """Passes read the stored study, not the table of parts that it is made from."""
    found = plan(catalog.queries()[name](spark, SMALL))
    assert "p_partkey" not in found


def test_parts_read_a_stored_panel(spark, monkeypatch):
    """The panel is made once for all parts of the attribution."""
    from tessera.plans import reports, storage, strategy

    made = []
    for m in (storage, strategy, reports):
        monkeypatch.setattr(m, "panel", lambda s, d, f=m.panel: made.append(1) or f(s, d))
    catalog.queries()["attribution_run_all"](spark, SMALL)
    assert len(made) == 1


def test_entities_share_the_calls_of_the_overlay_stream(spark):
    """State is kept by buckets of entities, so calls and timers don't grow with each entity; several buckets equal the batch fold."""
    from tessera.operators import overlay
    from tessera.streaming import feeds

    assert feeds._STATE.startswith("last array<struct<entity")
    rows = [(e, m, ((e * 7 + m * 5) % 19 - 9) / 9, ((e * 3 + m * 11) % 17 - 8) / 8, 0.1) for e in (0, 1, 255, 256, 700, 70000) for m in range(1, 9) if (e + m) % 5]
    df = spark.createDataFrame(rows, "entity long, seq int, ts double, ei double, weight double")
    want = sorted(feeds.rounded_overlay(overlay.run(df)).collect())
    assert sorted(feeds.rounded_overlay(feeds.stream_overlay(spark, df)).collect()) == want
