"""A user's own aggregates (X4) and table functions (X5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from longview.operators import custom
from longview.plans.view import run_view
from workload.facts import facts, facts_sql, table
from workload.registry import query, r, rounded


class GeometricMean(custom.GroupFunction):
    """exp of the mean logarithm; null if there's no value."""

    state, result = "n long, logs double", "value double"

    def update(self, rows, by):
        value = rows.columns[-1]
        return custom.grouped(rows.assign(logs=np.log(rows[value])), by).agg(n=("logs", "count"), logs=("logs", "sum"))

    def merge(self, states, by):
        return custom.grouped(states, by).agg(n=("n", "sum"), logs=("logs", "sum"))

    def finish(self, states, by):
        return states.assign(value=np.exp((states["logs"] / states["n"]).where(states["n"] > 0)))


class PowersOfTwo(custom.GroupFunction):
    """Rows (power, rows, total): how many values lie from 2 ** power to the next power, and their sum."""

    powers = range(-4, 20)
    state = ", ".join(f"n{i} long, s{i} double" for i in range(len(powers)))
    result = "power int, rows long, total double"

    def update(self, rows, by):
        value = rows[rows.columns[-1]]
        at = np.floor(np.log2(value)).clip(self.powers[0], self.powers[-1]) - self.powers[0]
        wide = {}
        for i in range(len(self.powers)):
            wide[f"n{i}"] = (at == i).astype("int64")
            wide[f"s{i}"] = value.where(at == i, 0.0)
        return custom.grouped(pd.concat([rows[by], pd.DataFrame(wide)], axis=1), by).sum()

    def merge(self, states, by):
        return custom.grouped(states, by).sum()

    def finish(self, states, by):
        parts = [states[by].assign(power=p, rows=states[f"n{i}"], total=states[f"s{i}"]) for i, p in enumerate(self.powers)]
        out = pd.concat(parts, ignore_index=True)
        return out[out["rows"] > 0]


class Moments(custom.GroupFunction):
    """Mean and standard deviation, merged without loss of digits."""

    state, result = "n long, mean double, squares double", "mean double, deviation double"

    def update(self, rows, by):
        value = rows.columns[-1]
        return custom.grouped(rows, by)[value].agg(n="count", mean="mean", squares=lambda x: ((x - x.mean()) ** 2).sum())

    def merge(self, states, by):
        states = states.assign(total=states["n"] * states["mean"].fillna(0.0))
        sums = custom.grouped(states, by).agg(n=("n", "sum"), total=("total", "sum"))
        whole = (sums["total"] / sums["n"]).rename("whole")
        back = states.merge(whole.reset_index(), on=by) if by else states.assign(whole=whole.iloc[0])
        back = back.assign(squares=back["squares"] + back["n"] * (back["mean"].fillna(0.0) - back["whole"]) ** 2)
        out = custom.grouped(back, by).agg(n=("n", "sum"), squares=("squares", "sum"), mean=("whole", "first"))
        return out[["n", "mean", "squares"]]

    def finish(self, states, by):
        return states.assign(deviation=np.sqrt(states["squares"] / states["n"]))


custom.register("geometric mean", GeometricMean())


@query("x4_user_aggregate", f"SELECT event_type, {r('exp(avg(ln(value)))', 6)} AS value FROM events GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_type", "value")
    return rounded(custom.group_function(d, ["event_type"], ["value"], GeometricMean()), 6, "value")


@query("x4_user_aggregate_in_view", f"SELECT scenario, tech, year, {r('exp(avg(ln(a)))', 4)} AS a FROM {facts_sql('scenario', 'tech', 'year', 'a')} GROUP BY 1, 2, 3")
def _(spark, sf):
    spec = {"x": "year", "y": "a", "y_agg": "geometric mean", "series": "tech", "explode": "scenario"}
    return rounded(run_view(facts(spark, sf, "scenario", "tech", "year", "a"), spec), 4, "a")


@query("x5_user_table_function", f"""
SELECT l_returnflag, CAST(floor(log2(l_extendedprice)) AS INTEGER) AS power, count(*) AS rows, {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(custom.group_function(d, ["l_returnflag"], ["l_extendedprice"], PowersOfTwo()), 2, "total")


@query("x5_user_row_function", f"SELECT event_id, {r('(value - avg(value) OVER w) / stddev_pop(value) OVER w', 6)} AS score FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "value")
    d = custom.with_group_result(d, ["event_type"], ["value"], Moments())
    return rounded(d.select("event_id", ((F.col("value") - F.col("mean")) / F.col("deviation")).alias("score")), 6, "score")
