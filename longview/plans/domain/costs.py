"""System cost, average price and abatement cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate, joins, reshape, windows
from longview.plans.domain.money import Money

# Column names and categories of cost tables.
COST = "Cost (Bil $)"
DISCOUNTED = "Discounted Cost (Bil $)"
CAPITAL, OPERATION = "Capital", "Operation"
CAPACITY_CATEGORY = "inv_investment_capacity_costs"
TRANSMISSION_CATEGORIES = ("inv_converter_costs", "inv_substation_investment_costs",
                           "inv_transmission_line_investment")


def unmapped_categories(sc: DataFrame, types: DataFrame) -> DataFrame:
    """Cost categories without a type."""
    return joins.unmapped(sc, "cost_cat", types)


def billions(sc: DataFrame, money: Money) -> DataFrame:
    return sc.withColumn(COST, money.inflate(COST) * F.lit(1e-9))


def system_cost(sc: DataFrame, money: Money = Money()) -> DataFrame:
    """Inflated cost in billions with its present value."""
    return billions(sc, money).withColumn(DISCOUNTED, money.discount(COST))


def objective_cost(sc: DataFrame, types: DataFrame, pvf_cap: DataFrame, pvf_onm: DataFrame,
                   money: Money = Money()) -> DataFrame:
    """Costs at their weight in the objective: capital and operation factors by year."""
    d = (billions(sc, money).join(pvf_cap, "year", "left").join(pvf_onm, "year", "left")
         .join(types, "cost_cat", "left"))
    factor = (F.when(F.col("type") == CAPITAL, F.col("pvfcap"))
               .when(F.col("type") == OPERATION, F.col("pvfonm")).otherwise(F.lit(1.0)))
    return d.withColumn(COST, F.col(COST) * factor).select(*sc.columns)


def historical_capex(capex_init: DataFrame, region_map: DataFrame, valid: DataFrame,
                     by_region: bool, money: Money = Money()) -> DataFrame:
    """Yearly investment before the model horizon in the modelled areas (billions)."""
    table = reshape.with_identity(region_map.select("rs", "r"), "rs", "r")
    modelled = (capex_init.join(table, capex_init["region"] == table["rs"], "inner")
                .join(valid.select(F.col(valid.columns[0]).alias("r")), "r", "left_semi"))
    keys = [F.col("t").alias("year"), *([F.col("region").alias("r")] if by_region else [])]
    named = modelled.select(*keys, "capex")
    out = named.groupBy(*[c for c in named.columns if c != "capex"]).agg(F.sum("capex").alias("capex"))
    return out.withColumn("capex", money.inflate(F.col("capex") / F.lit(1e9)))


def recovery_factors(years: DataFrame, crf: DataFrame | None, n: int, money: Money) -> DataFrame:
    """Capital recovery factor per year of the axis: constant, or interpolated model values."""
    if crf is None:
        return years.withColumn("crf", F.lit(S.capital_recovery_factor(money.rate, n)))
    axis = years.join(crf.select("year", "crf"), "year", "left").withColumn("__all", F.lit(0))
    return windows.bfill(windows.interpolate(axis, "crf", ["__all"], "year"), "crf", ["__all"], ["year"]).drop("__all")


def annualized_cost(sc: DataFrame, types: DataFrame, eval_years: int, transmission_years: int,
                    money: Money = Money(), crf: DataFrame | None = None, by_region: bool = False,
                    shift_capital: bool = False, history: DataFrame | None = None,
                    remove_existing: bool = False) -> DataFrame:
    """Investments spread over their payment years, operation costs carried forward.

    The table stays long: one row per (region,) category and year of the complete axis.
    ``crf=None`` uses the factor of the discount rate.  ``history`` holds capital spent
    before the first model year.
    """
    n, t = eval_years, transmission_years
    ids = ["r"] if by_region else []
    first, last = sc.agg(F.min("year")).scalar(), sc.agg(F.max("year")).scalar()
    # Duplicates of a cell are averaged, as in a wide mean table.
    costs = billions(sc, money).groupBy(*ids, "cost_cat", "year").agg(F.avg(COST).alias(COST))
    kept = costs.filter(F.col("year") >= money.pv_year) if remove_existing else costs
    groups = aggregate.grid(kept, [*ids, "cost_cat"]) if ids else kept.select("cost_cat").distinct()
    groups = groups.join(types.select("cost_cat", "type"), "cost_cat", "inner")
    axis = joins.expand_years(groups, first - F.lit(n), last + F.lit(max(n, t)))
    d = axis.join(kept, [*ids, "cost_cat", "year"], "left")
    if history is not None and not remove_existing:
        spent = (F.col("cost_cat") == CAPACITY_CATEGORY) & (F.col("year") < first)
        d = (d.join(history, ["year", *ids], "left")
              .withColumn(COST, F.when(spent, F.col("capex")).otherwise(F.col(COST))).drop("capex"))
    years = sc.sparkSession.range(1).select(
        F.explode(F.sequence(first - F.lit(n), last + F.lit(max(n, t)))).alias("year"))
    d = d.join(recovery_factors(years, crf, n, money), "year", "left")
    key = [*ids, "cost_cat"]
    if shift_capital:
        d = d.withColumn("crf", F.col("crf") / F.lit(1 + money.rate)).withColumn("__inv", F.col(COST))
    else:
        d = windows.lag_by(d, COST, key, ["year"], "__inv")
    d = d.withColumn("__pay", F.coalesce(F.col("__inv"), F.lit(0.0)) * F.col("crf"))
    d = windows.rolling_sum(d, "__pay", key, ["year"], n, "__short")
    d = windows.rolling_sum(d, "__pay", key, ["year"], t, "__long")
    capital = F.when(F.col("cost_cat").isin(*TRANSMISSION_CATEGORIES), F.col("__long")).otherwise(F.col("__short"))
    d = d.withColumn("__capital", capital).filter(F.col("year") >= first)
    d = windows.ffill(d, COST, key, ["year"], n - 1)
    value = F.when(F.col("type") == CAPITAL, F.col("__capital")).otherwise(F.col(COST))
    out = d.select(*ids, "year", "cost_cat", F.coalesce(value, F.lit(0.0)).alias(COST))
    return out.withColumn(DISCOUNTED, money.discount(COST))


def load_by_year(q: DataFrame) -> DataFrame:
    return q.filter(F.col("type") == "load").groupBy("year").agg(F.sum("q").alias("q"))


def average_price_national(cost: DataFrame, q: DataFrame) -> DataFrame:
    """Annualized cost per MWh; load of years without a value is carried forward."""
    first, last = cost.agg(F.min("year")).scalar(), cost.agg(F.max("year")).scalar()
    load = load_by_year(q)
    axis = cost.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("year"), F.lit(0).alias("__all"))
    full = windows.ffill(axis.join(load, "year", "left"), "q", ["__all"], ["year"]).drop("__all")
    d = cost.join(full, "year", "left")
    return d.withColumn("Average cost ($/MWh)", S.ratio(F.col(COST) * 1e9, "q"))


def regional_cost(sc: DataFrame, types: DataFrame, region_map: DataFrame, crf: DataFrame, existing: DataFrame,
                  money: Money = Money(), horizon: int = 20) -> DataFrame:
    """Annualized cost by area, including payments for existing capacity.

    Operation costs are carried forward without limit but end before the last year.
    """
    table = region_map.select(F.col("rs").alias("raw"), F.col("r").alias("display"))
    costs = (joins.map_values(billions(sc, money), "region", table)
             .groupBy("cost_cat", "region", "year").agg(F.sum(COST).alias(COST)))
    first, last = costs.agg(F.min("year")).scalar(), costs.agg(F.max("year")).scalar()
    lo, hi = first - F.lit(horizon - 1), last + F.lit(horizon)
    groups = costs.select("region", "cost_cat").distinct().join(types.select("cost_cat", "type"), "cost_cat", "inner")
    d = joins.expand_years(groups, lo, hi).join(costs, ["region", "cost_cat", "year"], "left")
    years = sc.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("year"))
    d = d.join(recovery_factors(years, crf, horizon, money), "year", "left")
    key = ["region", "cost_cat"]
    d = windows.lag_by(d, COST, key, ["year"], "__inv")
    d = d.withColumn("__pay", F.coalesce(F.col("__inv"), F.lit(0.0)) * F.col("crf"))
    d = windows.rolling_sum(d, "__pay", key, ["year"], horizon, "__capital").filter(F.col("year") >= first)
    d = windows.ffill(d, COST, key, ["year"])
    running = F.when(F.col("year") == hi, F.lit(0.0)).otherwise(F.col(COST))
    value = F.when(F.col("type") == CAPITAL, F.col("__capital")).otherwise(running)
    long = d.select("year", "region", "cost_cat", F.coalesce(value, F.lit(0.0)).alias(COST))
    # Every area gets every category, so that existing payments have a row to go to.
    cells = aggregate.grid(long, ["year", "region", "cost_cat"])
    full = cells.join(long, ["year", "region", "cost_cat"], "left").fillna(0.0, [COST])
    paid = existing.select("year", "region", money.inflate("existingcap").alias("__old"))
    extra = F.when(F.col("cost_cat") == CAPACITY_CATEGORY, F.coalesce(F.col("__old"), F.lit(0.0))).otherwise(F.lit(0.0))
    return (full.join(paid, ["year", "region"], "left")
                .select("year", "region", "cost_cat", (F.col(COST) + extra).alias(COST)))


def _trade(df: DataFrame, region: str, category: str, value: Column) -> DataFrame:
    return (df.groupBy("year", F.col(region).alias("region")).agg(F.sum(value).alias(COST))
              .withColumn("cost_cat", F.lit(category)).select("year", "region", "cost_cat", COST))


def capacity_trade_cost(captrade: DataFrame, p: DataFrame) -> DataFrame:
    """Cost of imported and revenue of exported firm capacity by area."""
    amount = captrade.groupBy("rb_out", "rb_in", "season", "year").agg(F.sum("Amount (MW)").alias("mw"))
    price = p.filter(F.col("type") == "res_marg").select(
        F.col("rb").alias("rb_out"), F.col("timeslice").alias("season"), "year", "p")
    d = (amount.join(price, ["rb_out", "season", "year"], "left").dropna()
         .withColumn("cost", F.col("p") * F.col("mw") * 1e3 / 1e9))
    return _trade(d, "rb_in", "cap_trade_import_cost", F.col("cost")).unionByName(
        _trade(d, "rb_out", "cap_trade_export_cost", -F.col("cost")))


def energy_trade_cost(gen: DataFrame, p: DataFrame, upstream: DataFrame, downstream: DataFrame,
                      hours: DataFrame) -> DataFrame:
    """Cost of imported and revenue of exported energy by area.

    ``upstream``/``downstream``: ``r, rr, timeslice, year, frac``; own-area rows do not count.
    """
    g = gen.groupBy("r", "timeslice", "year").agg(F.sum("Generation (GW)").alias("gw"))
    price = p.filter(F.col("type") == "load").select(F.col("rb").alias("r"), "timeslice", "year", "p")
    slot = hours.select("timeslice", "hours")
    value = F.col("frac") * F.col("gw") * F.col("p") * F.col("hours") / 1e9
    imports = (upstream.filter(F.col("r") != F.col("rr")).join(g, ["r", "timeslice", "year"], "left")
               .join(price.withColumnRenamed("r", "rr"), ["rr", "timeslice", "year"], "left")
               .join(slot, "timeslice", "left"))
    sold = (downstream.filter(F.col("r") != F.col("rr"))
            .groupBy(F.col("rr").alias("r"), "timeslice", "year").agg(F.sum("frac").alias("frac")))
    exports = (sold.join(g, ["r", "timeslice", "year"], "left").join(price, ["r", "timeslice", "year"], "left")
               .join(slot, "timeslice", "left"))
    zero = F.coalesce(value, F.lit(0.0))
    return _trade(imports, "r", "energy_trade_import_cost", zero).unionByName(
        _trade(exports, "r", "energy_trade_export_cost", -zero))


def average_price_regional(parts: list[DataFrame], q: DataFrame) -> DataFrame:
    """All cost parts per MWh of the area's load; rows without load are dropped."""
    load = (q.filter(F.col("type") == "load").groupBy("year", F.col("rb").alias("region"))
             .agg(F.sum("q").alias("load (MWh)")))
    d = reshape.union_by_name(*parts).join(load, ["year", "region"], "left").dropna()
    return (d.withColumn("Average cost ($/MWh)", S.ratio(F.col(COST) * 1e9, "load (MWh)"))
             .withColumnRenamed("region", "rb"))


def _quantities(df: DataFrame, label: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, "val").withColumn("type", F.lit(label))


def abatement_objective(objective: DataFrame, emit: DataFrame, pvf_onm: DataFrame) -> DataFrame:
    """Objective costs and weighted emissions in one table."""
    cost = objective.withColumnRenamed(COST, "val").withColumn("type", F.lit(COST))
    co2 = (emit.join(pvf_onm, "year", "left")
           .withColumn("val", F.col("CO2 (MMton)") * 1e-3 * F.col("pvfonm"))
           .drop("pvfonm", "CO2 (MMton)")
           .withColumn("type", F.lit("CO2 (Bil metric ton)")).withColumn("cost_cat", F.lit("CO2 (Bil metric ton)")))
    return cost.unionByName(co2, allowMissingColumns=True)


def abatement_annualized(cost: DataFrame, emit: DataFrame, money: Money = Money()) -> DataFrame:
    """Annualized costs and emissions, with discounted and cumulative columns."""
    c = (cost.groupBy("year", "cost_cat").agg(F.sum(COST).alias("val")).withColumn("type", F.lit(COST)))
    first, last = c.agg(F.min("year")).scalar(), c.agg(F.max("year")).scalar()
    axis = cost.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("year"), F.lit(0).alias("__all"))
    co2 = axis.join(emit.select("year", (F.col("CO2 (MMton)") * 1e-3).alias("val")), "year", "left")
    co2 = (windows.ffill(co2, "val", ["__all"], ["year"]).drop("__all")
           .withColumn("type", F.lit("CO2 (Bil metric ton)")).withColumn("cost_cat", F.lit("CO2 (Bil metric ton)")))
    d = c.unionByName(co2).withColumn("disc val", money.discount("val"))
    d = windows.running_sum(d, "val", ["cost_cat"], ["year"], "cum val")
    return windows.running_sum(d, "disc val", ["cost_cat"], ["year"], "cum disc val")
