"""Queries that run streams, and the trained scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import boosting, portfolio, scorers
from tessera.sources.tables import panel, with_target
from tessera.streaming import feeds

from .reports import SQL as REPORTS
from .strategy import FEATURES
from .strategy import SQL as STRATEGY
from .strategy import _overlay_input


def _scored(s, d):
    return scorers.score_windows(*_labelled(s, d), FEATURES).select("window_id", "entity", "month_idx", "score_a", "score_b", "score", "score_cv")


def _labelled(s, d):
    """Rows with labels, written once, and the small table of windows."""
    df = feeds.written(portfolio.label_rank(with_target(panel(s, d))).select("entity", "month_idx", "label_rank", *FEATURES))
    windows = portfolio.rolling_windows(df)
    return df, s.createDataFrame(windows.collect(), windows.schema)


def _boosted(s, d):
    """Scores, importances and histories of every rolling window."""
    return boosting.fit_windows(*_labelled(s, d), FEATURES, settings=boosting.Settings(rounds=6))


#: Candidates of the registered trials.
GRID = [boosting.Settings(rounds=3, depth=2, rate=0.3), boosting.Settings(rounds=3, depth=3, rate=0.1, decay_every=1, decay=0.5)]

QUERIES = {
    "stream_bars": feeds.stream_bars,
    "stream_overlay": lambda s, d: feeds.rounded_overlay(feeds.stream_overlay(s, _overlay_input(s, d))),
    "train_scorer": _scored,
    "boosted_scores": lambda s, d: _boosted(s, d)[0].filter("split = 'test'").select("window_id", "entity", "month_idx", F.round("score", 9).alias("score")),
    "boosted_importance": lambda s, d: _boosted(s, d)[1],
    "run_trials": lambda s, d: boosting.run_trials(*_labelled(s, d), FEATURES, GRID, feeds.scratch(s)),
}
SQL = {"stream_bars": REPORTS["bars_from_events"], "stream_overlay": STRATEGY["risk_overlay"]}
