"""Queries of the rolling factor families."""

from __future__ import annotations

from functools import partial

from tessera.operators import factors
from tessera.sources.tables import bars


def _family(name, spark, sf_dir):
    return factors.family(bars(spark, sf_dir), name)


QUERIES = {f"factor_{name}": partial(_family, name) for name in ("minimum", *factors.FAMILIES)}
QUERIES["factor_ema"] = lambda spark, sf_dir: factors.ema(bars(spark, sf_dir), digits=4)
SQL = {f"factor_{name}": factors.family_sql(name) for name in ("minimum", *factors.FAMILIES)}
SQL["factor_ema"] = factors.ema_sql()
