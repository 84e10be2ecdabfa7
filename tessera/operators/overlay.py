"""Stateful risk overlay: trend and emotion of each holding month by month, with hysteresis, sales and re-entry.

A sale resets the state that led to it, so there is no plain window form: the months of an entity (a few hundred at most)
are folded in order as one array, inside the JVM. `tessera.streaming.overlay` keeps the same state in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import clip

THRESHOLD, BAND = -1.0, 0.05


def trend_score(categories: list[list[Column]]) -> Column:
    """Votes (true +1, false -1, NULL none) averaged within each category that has any, then over these; none at all: 0."""
    means = []
    for votes in categories:
        cast = F.filter(F.array(*[F.when(v, 1.0).when(~v, -1.0) for v in votes]), lambda x: x.isNotNull())
        means.append(F.when(F.size(cast) > 0, F.aggregate(cast, F.lit(0.0), lambda a, x: a + x) / F.size(cast)))
    present = F.filter(F.array(*means), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)).otherwise(0.0)


def emotion_index(oscillators: list[tuple[str, int]]) -> Column:
    """Mean of the oscillators (column, +1 or -1) within +-3, over 3; missing ones left out, none at all: 0."""
    terms = F.filter(F.array(*[clip(F.col(c) * float(d), -3.0, 3.0) / 3 for c, d in oscillators]), lambda x: x.isNotNull())
    return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(terms)).otherwise(0.0)


def run(holdings: DataFrame, threshold: float = THRESHOLD, band: float = BAND) -> DataFrame:
    """holdings (entity, seq, ts, ei, weight; seq numbers the processed months) with sign, ats, timing, sold and label.

    New (absent in the processed month before, or sold there): the sign is that of ei and ats = ts. A crossing beyond the
    band turns the sign and renews ats. ats - ei under the threshold sells.
    """
    item = F.struct("seq", "ts", "ei", "weight")
    by = holdings.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("x"))
    row = "struct<seq:int,ts:double,ei:double,weight:double,sign:int,ats:double,timing:double,sold:boolean,label:string>"
    start = F.struct(F.lit(-9).alias("seq"), F.lit(0).alias("sign"), F.lit(0.0).alias("ats"), F.lit(False).alias("sold"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        kept = acc["seq"] == v["seq"] - 1
        new = ~kept | acc["sold"]
        crossed = F.when(acc["sign"] > 0, v["ei"] < -band).otherwise(v["ei"] > band)
        sign = F.when(new, F.when(v["ei"] >= 0, 1).otherwise(-1)).when(crossed, -acc["sign"]).otherwise(acc["sign"])
        ats = F.when(new | crossed, v["ts"]).otherwise(acc["ats"])
        timing = ats - v["ei"]
        sold = timing < threshold
        label = F.when(sold, "SELL").when(kept & acc["sold"], "REENTER").otherwise("HOLD")
        out = F.struct(v["seq"].alias("seq"), v["ts"].alias("ts"), v["ei"].alias("ei"), v["weight"].alias("weight"), sign.alias("sign"), ats.alias("ats"), timing.alias("timing"), sold.alias("sold"), label.alias("label"))
        return F.struct(v["seq"].alias("seq"), sign.alias("sign"), ats.alias("ats"), sold.alias("sold"), F.concat(acc["out"], F.array(out.cast(row))).alias("out"))

    done = by.select("entity", F.explode(F.aggregate("x", start, step)["out"]).alias("z"))
    return done.select("entity", "z.*")


def cash_pool(done: DataFrame, rf_annual: float = 0.025) -> DataFrame:
    """Freed weight and its return of each month in which something is sold."""
    return done.filter("sold").groupBy("seq").agg(F.sum("weight").alias("cash_weight")).withColumn("rf", F.lit(rf_annual / 12))
