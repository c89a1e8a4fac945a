"""Requirement prices, value streams, value factors and competitiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate, joins, reshape
from longview.plans.domain.money import Money
from longview.plans.domain.regions import to_balancing_area

# Equation and variable names of the value-stream table.
COST_STREAMS = ("eq_gasaccounting_regional", "eq_gasaccounting_national", "eq_bioused", "eq_gasused",
                "eq_objfn_inv", "eq_objfn_op")
VALUE_STREAMS = ("eq_supply_demand_balance", "eq_reserve_margin", "eq_opres_requirement", "eq_rec_requirement",
                 "eq_curt_gen_balance", "eq_curtailment", "eq_storage_in_max", "eq_storage_in_min")
FLAT_BLOCK_STREAMS = ("eq_supply_demand_balance", "eq_reserve_margin")
OBJECTIVE_STREAMS = ("eq_objfn_inv", "eq_objfn_op")
LINKING_EQUATIONS = ("eq_cap_new_noret", "eq_cap_new_retub", "eq_cap_new_retmo", "eq_cap_upgrade", "eq_captran")
INVESTMENT_VARS = ("inv", "inv_refurb", "upgrades", "invtran")
CAPACITY_VARS = ("cap", "captran")
CUMULATIVE_VARS = ("gen", "cap", "opres", "storage_in", "captran", "flow", "opres_flow", "prmtrade",
                   "storage_in_pvb_p", "storage_in_pvb_g", "cap_sdbin", "storage_level", "recs",
                   "gen_pvb_p", "gen_pvb_b", "produce")
PRICE_TYPES = ("load", "res_marg", "oper_res", "state_rps", "nat_gen")
BENCHMARK_TYPES = ("load", "res_marg", "oper_res", "state_rps")
# Requirement type behind each of the first value streams, in the same order.
STREAM_TYPES = ("load", "res_marg", "oper_res", "state_rps", "curt_realize", "curt_cause")
INDEX = ["tech", "vintage", "rb", "year"]
REQUIREMENT = ["type", "subtype", "rb", "timeslice", "year"]


def priced_requirements(q: DataFrame, p: DataFrame, money: Money = Money()) -> DataFrame:
    """Quantities with their inflated price; requirements without a price cost nothing."""
    price = p.select(*REQUIREMENT, money.inflate("p").alias("p"))
    return joins.left_fill(q, price, REQUIREMENT, "p", 0.0)


def requirement_prices(q: DataFrame, p: DataFrame, money: Money = Money()) -> DataFrame:
    """Cost of each requirement, a total over the main types, and the quantities themselves."""
    cost = priced_requirements(q, p, money).select(*REQUIREMENT, (F.col("p") * F.col("q")).alias("$"))
    main = cost.filter(F.col("type").isin(*PRICE_TYPES))
    total = (main.groupBy("rb", "timeslice", "year").agg(F.sum("$").alias("$"))
             .withColumn("type", F.lit("tot")).withColumn("subtype", F.lit("na")))
    amounts = q.select(F.concat(F.lit("q_"), "type").alias("type"), *REQUIREMENT[1:], F.col("q").alias("$"))
    return reshape.union_by_name(cost, total, amounts)


def gas_price(q: DataFrame, p: DataFrame, money: Money = Money()) -> DataFrame:
    """Fuel quantity with its inflated price by census area."""
    price = p.select("census", "year", money.inflate("p").alias("p"))
    return joins.left_fill(q, price, ["census", "year"], "p", 0.0)


def without_investments(vs: DataFrame) -> DataFrame:
    return vs.filter(~F.col("var_name").isin(*INVESTMENT_VARS))


def prefer_uncurtailed(gen: DataFrame, uncurtailed: DataFrame) -> DataFrame:
    """Generation, replaced by the uncurtailed table for the technologies it covers."""
    return joins.drop_members(gen, uncurtailed, "tech").unionByName(uncurtailed, allowMissingColumns=True)


def investment_scale(vs: DataFrame) -> DataFrame:
    """Ratio of investment to capacity streams in the equations that link both."""
    def total(names: tuple, out: str) -> Column:
        return F.sum(F.when(F.col("var_name").isin(*names), F.col("$"))).alias(out)

    d = (vs.filter(F.col("con_name").isin(*LINKING_EQUATIONS)).groupBy(*INDEX)
           .agg(total(INVESTMENT_VARS, "__inv"), total(CAPACITY_VARS, "__cap")))
    both = d.filter(F.col("__inv").isNotNull() & F.col("__cap").isNotNull())
    return both.select(*INDEX, (S.ratio("__inv", "__cap") * -1).alias("mult"))


def investment_only(vs: DataFrame, gen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Value streams and generation reduced to investment years."""
    mult = investment_scale(vs)
    cum = vs.filter(F.col("var_name").isin(*CUMULATIVE_VARS))
    scaled = mult.join(cum, INDEX, "left").withColumn("$", F.col("$") * F.col("mult")).select(*vs.columns)
    streams = vs.filter(F.col("var_name").isin(*INVESTMENT_VARS)).unionByName(scaled)
    energy = mult.join(gen, INDEX, "left").withColumn("MWh", F.col("MWh") * F.col("mult")).select(*gen.columns)
    return streams, energy


def value_streams(vs: DataFrame, gen: DataFrame, cap: DataFrame, pvf_cap: DataFrame, pvf_onm: DataFrame,
                  cost_scale, region_map: DataFrame, money: Money = Money()) -> DataFrame:
    """Present values of all streams, with energy (MWh) and capacity (kW) rows beside them."""
    scale = F.lit(cost_scale) if not isinstance(cost_scale, Column) else cost_scale
    money_rows = (vs.join(pvf_cap, "year", "left")
                  .withColumn("Bulk $", S.ratio(S.ratio(money.inflate("$"), scale), "pvfcap"))
                  .select(*INDEX, "var_name", "con_name", "Bulk $"))
    energy = (gen.groupBy(*INDEX).agg(F.sum("MWh").alias("MWh")).join(pvf_cap, "year", "left").join(pvf_onm, "year", "left")
              .select(*INDEX, F.lit("MWh").alias("var_name"), F.lit("MWh").alias("con_name"),
                      S.ratio(F.col("MWh") * F.col("pvfonm"), "pvfcap").alias("Bulk $")))
    power = (to_balancing_area(cap, region_map).groupBy(*INDEX).agg(F.sum("MW").alias("MW"))
             .select(*INDEX, F.lit("kW").alias("var_name"), F.lit("kW").alias("con_name"),
                     (F.col("MW") * 1000).alias("Bulk $")))
    d = reshape.union_by_name(money_rows, energy, power)
    pair = S.join_text(", ", "var_name", "con_name")
    return (d.withColumn("Bulk $ Dis", money.discount("Bulk $"))
             .withColumn("tech, vintage", S.join_text(", ", "tech", "vintage"))
             .withColumn("var, con", pair)
             .withColumn("con_adj", F.when(F.col("con_name").isin(*OBJECTIVE_STREAMS), pair).otherwise(F.col("con_name"))))


def value_factors(vs: DataFrame, gen: DataFrame, q: DataFrame, p: DataFrame, pvf_onm: DataFrame, cost_scale,
                  hours: DataFrame, money: Money = Money()) -> DataFrame:
    """Value of each stream beside four benchmark values of the same energy.

    Benchmarks: all requirements (local and system-wide) and a flat block of energy plus
    reserve (local and system-wide), each as a price times the technology's generation.
    """
    key = ["tech", "rb", "year"]
    scale = F.lit(cost_scale) if not isinstance(cost_scale, Column) else cost_scale
    energy = gen.groupBy(*key).agg(F.sum("MWh").alias("MWh"))
    streams = (vs.filter(F.col("con_name").isin(*VALUE_STREAMS)).groupBy(*key, "con_name")
               .agg(F.sum(money.inflate("$")).alias("$")))
    full = aggregate.complete_categories(streams, key, "con_name", "$")
    df = (full.join(pvf_onm, "year", "left")
          .withColumn("$", S.ratio(S.ratio("$", scale), "pvfonm")).drop("pvfonm"))

    pairs = dict(zip(STREAM_TYPES, VALUE_STREAMS))
    stream_of = F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])
    bm = (priced_requirements(q, p, money).filter(F.col("type").isin(*STREAM_TYPES))
          .withColumn("con_name", F.try_element_at(stream_of, F.col("type"))))
    load = q.filter(F.col("type") == "load").groupBy("rb", "year").agg(F.sum("q").alias("load"))

    local = (bm.groupBy("con_name", "rb", "year").agg(F.sum(F.col("p") * F.col("q")).alias("__v"))
             .join(load, ["rb", "year"], "left"))
    all_local = local.select("con_name", "rb", "year", S.ratio("__v", "load").alias("$ all-in loc"))
    all_system = (local.groupBy("con_name", "year").agg(S.ratio(F.sum("__v"), F.sum("load")).alias("$ all-in sys")))

    flat = bm.filter(F.col("con_name").isin(*FLAT_BLOCK_STREAMS)).join(hours, "timeslice", "left")
    price = F.when(F.col("con_name") == FLAT_BLOCK_STREAMS[0], F.col("p") * F.col("hours") / 1000).otherwise(F.col("p"))
    flat_local = flat.groupBy("con_name", "rb", "year").agg((F.sum(price) / F.lit(S.MWH_PER_FLAT_KW)).alias("$ flat loc"))
    weighted = flat_local.join(load, ["rb", "year"], "left")
    flat_system = weighted.groupBy("con_name", "year").agg(
        S.ratio(F.sum(F.col("$ flat loc") * F.col("load")), F.sum("load")).alias("$ flat sys"))

    columns = ["$ all-in loc", "$ all-in sys", "$ flat loc", "$ flat sys"]
    out = (df.join(all_local, ["year", "rb", "con_name"], "left").join(all_system, ["year", "con_name"], "left")
             .join(flat_local, ["year", "rb", "con_name"], "left").join(flat_system, ["year", "con_name"], "left")
             .join(energy, key, "left"))
    out = out.select(*key, "con_name", "$", *[(F.col(c) * F.col("MWh")).alias(c) for c in columns])
    mwh = energy.select(*key, F.lit("MWh").alias("con_name"), F.col("MWh").alias("$"),
                        *[F.col("MWh").alias(c) for c in columns])
    return out.unionByName(mwh).fillna(0, subset=["$", *columns])


def benchmark_price(prices: DataFrame) -> DataFrame:
    """Cost of the four main requirements per unit of load, by year."""
    def total(name: str) -> Column:
        return F.sum(F.when(F.col("type") == name, F.col("$")))

    cost = None
    for name in BENCHMARK_TYPES:
        cost = total(name) if cost is None else cost + total(name)
    return prices.groupBy("year").agg(S.ratio(cost, total("q_load")).alias("P_b"))


def competitiveness(streams: DataFrame, prices: DataFrame) -> DataFrame:
    """Levelized cost and value measures per technology, vintage, area and year.

    ``streams`` is the result of :func:`value_streams`, ``prices`` of :func:`requirement_prices`.
    """
    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("Bulk $ Dis")))

    con = F.col("con_name")
    d = (streams.groupBy(*INDEX).agg((total(con.isin(*COST_STREAMS)) * -1).alias("Cost $"),
                                     total(con == "MWh").alias("MWh"),
                                     total(con.isin(*VALUE_STREAMS)).alias("Value $"))
                .filter(F.col("Cost $").isNotNull())
                .join(benchmark_price(prices), "year", "left").select(*INDEX, "Cost $", "MWh", "Value $", "P_b"))
    return (d.withColumn("LCOE", S.ratio("Cost $", "MWh"))
             .withColumn("LVOE", S.ratio("Value $", "MWh"))
             .withColumn("NVOE", F.col("LVOE") - F.col("LCOE"))
             .withColumn("BCR", S.ratio("Value $", "Cost $"))
             .withColumn("PLCOE", S.ratio(F.col("P_b") * F.col("Cost $"), "Value $"))
             .withColumn("value factor", S.ratio("LVOE", "P_b"))
             .withColumn("integration cost", F.col("P_b") - F.col("LVOE"))
             .withColumn("SLCOE", F.col("LCOE") + F.col("integration cost")))
