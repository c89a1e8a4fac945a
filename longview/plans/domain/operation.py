"""Generation, curtailment, capacity, storage, emissions and transmission results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import scalars as S
from longview.operators import aggregate, joins, project, reshape, windows
from longview.plans.domain.money import Money
from longview.plans.domain.regions import to_balancing_area

# Column names of result tables.
UNCURT, CURT, RATE = "MWh uncurt", "MWh curt", "Curt Rate"
UNIT = ["tech", "vintage", "rb", "year"]
SPUR_TECHS = ("wind-ons", "upv")


def generation_with_load(gen: DataFrame, uncurtailed: DataFrame, load: DataFrame) -> DataFrame:
    """National generation as fractions of load and losses (TWh)."""
    a = gen.groupBy("tech", "year").agg(F.sum("Gen (TWh)").alias("Gen (TWh)"))
    b = uncurtailed.groupBy("tech", "year").agg(F.sum("Gen Uncurt (TWh)").alias("Gen Uncurt (TWh)"))
    d = joins.outer_fill(a, b, ["tech", "year"], {"Gen (TWh)": 0.0, "Gen Uncurt (TWh)": "Gen (TWh)"})
    for c in ("Gen (TWh)", "Gen Uncurt (TWh)"):
        d = project.scale(d, c, 1e-6)
    wide = reshape.pivot_mean(project.scale(load, "TWh", 1e-6), ["year"], "type", "TWh",
                              ["curt", "load", "storage", "trans"])
    d = d.join(wide, "year", "left")
    some = F.col("load") + F.col("storage") + F.col("trans")
    return (d.withColumn("Gen Frac of Load", S.ratio("Gen (TWh)", "load"))
             .withColumn("Gen Frac of Load Plus Stor/Trans Loss", S.ratio("Gen (TWh)", some))
             .withColumn("Gen Uncurt Frac of Load", S.ratio("Gen Uncurt (TWh)", "load"))
             .withColumn("Gen Uncurt Frac of Load Plus All Losses", S.ratio("Gen Uncurt (TWh)", some + F.col("curt"))))


def reduced_cost(df: DataFrame) -> DataFrame:
    """Composite key of a reduced-cost row."""
    return df.withColumn("irbv", S.join_text(" | ", "tech", "region", "bin", "variable"))


def joint_locations(df: DataFrame, first: str, second: str, new: str) -> DataFrame:
    return df.withColumn(new, S.join_text("-", first, second))


def levelized_cost(lcoe: DataFrame, avail: DataFrame, inv: DataFrame, money: Money = Money()) -> DataFrame:
    """Levelized cost of each supply bin with availability and investment flags."""
    key = ["tech", "region", "year", "bin"]
    d = joins.left_fill(lcoe.withColumn("$/MWh", money.inflate("$/MWh")), avail, key, "available MW", 0.0)
    d = project.flag(d, "available", F.col("available MW") > 0.001)
    d = joins.left_fill(d, inv, ["tech", "vintage", *key[1:]], "chosen MW", 0.0)
    d = project.flag(d, "chosen", F.col("chosen MW") != 0)
    return d.withColumn("icrb", S.join_text(" | ", "tech", "vintage", "region", "bin"))


def curtailment_of_new(uncurtailed: DataFrame, rate: DataFrame, annual: bool = False) -> DataFrame:
    """Marginal curtailment rate of new capacity, by slice or as a yearly average."""
    key = ["tech", "region", "timeslice", "year"]
    d = joins.left_fill(uncurtailed, rate, key, RATE, 0.0)
    if not annual:
        return d
    out = d.groupBy("tech", "region", "year").agg(
        F.sum(UNCURT).alias(UNCURT), F.sum(F.col(RATE) * F.col(UNCURT)).alias(CURT))
    return out.withColumn(RATE, F.coalesce(S.ratio(CURT, UNCURT), F.lit(0.0)))


def capacity_credit_of_new(cap: DataFrame, cc: DataFrame) -> DataFrame:
    return joins.left_fill(cap, cc, ["tech", "region", "season", "year"], "CC Rate", 0.0)


def firm_capacity(cap: DataFrame, firm: DataFrame, region_map: DataFrame, credit: bool = False) -> DataFrame:
    """Capacity of every season beside its firm part (GW), optionally their ratio."""
    total = to_balancing_area(cap, region_map, ["tech", "rb", "year"])
    seasonal = joins.expand_by(total, firm.select("season").distinct())
    d = seasonal.join(firm, ["tech", "rb", "year", "season"], "left").fillna(0)
    for c in ("Capacity (GW)", "Firm Capacity (GW)"):
        d = project.scale(d, c, 1e-3)
    return d.withColumn("Capacity Credit", S.ratio("Firm Capacity (GW)", "Capacity (GW)")) if credit else d


def curtailment(uncurtailed: DataFrame, gen: DataFrame, load: DataFrame) -> DataFrame:
    """Curtailment rate of each unit beside the renewable share of its area and of the nation."""
    d = joins.left_fill(uncurtailed, gen, UNIT, "MWh", 0.0).withColumn(RATE, F.lit(1.0) - S.ratio("MWh", UNCURT))

    def penetration(keys: list[str], out: str) -> DataFrame:
        made = uncurtailed.groupBy(*keys).agg(F.sum(UNCURT).alias("__g"))
        used = load.groupBy(*keys).agg(F.sum("MWh load").alias("__l"))
        return used.join(made, keys, "left").select(*keys, S.ratio("__g", "__l").alias(out))

    return (d.join(penetration(["rb", "year"], "VRE penetration n"), ["rb", "year"], "left")
             .join(penetration(["year"], "VRE penetration nat"), "year", "left"))


def curtailment_iterations(uncurtailed: DataFrame, curt: DataFrame) -> DataFrame:
    """Generation of the curtailed technologies and their curtailment, stacked and tagged."""
    gen = joins.keep_members(uncurtailed, curt, "tech").withColumn("type", F.lit("gen"))
    return reshape.union_by_name(gen, curt.withColumn("type", F.lit("curt")))


def capacity_credit_iterations(cap: DataFrame, firm: DataFrame) -> DataFrame:
    """Capacity of every season and firm capacity, stacked and tagged."""
    kept = joins.keep_members(cap, firm, "tech").withColumn("type", F.lit("cap"))
    seasonal = joins.expand_by(kept, firm.select("season").distinct())
    return reshape.union_by_name(seasonal, firm.withColumn("type", F.lit("cap_firm")))


def capacity_factor(cap: DataFrame, output: DataFrame, region_map: DataFrame, by: list[str] | None = None,
                    capacity: str = "MW", produced: str = "MWh") -> DataFrame:
    """Output over capacity times the hours of a year.

    Also serves hydrogen: ``capacity="Capacity (tonnes)"``, ``produced="Production (tonnes)"``.
    """
    by = by or UNIT
    total = to_balancing_area(cap, region_map).groupBy(*by).agg(F.sum(capacity).alias(capacity))
    d = joins.left_fill(total, output, by, produced, 0.0)
    return d.withColumn("CF", S.ratio(produced, F.col(capacity) * S.HOURS_PER_YEAR))


def capacity_factor_of_new(gen: DataFrame, cap: DataFrame) -> DataFrame:
    key = ["tech", "rs", "year"]
    total = gen.groupBy(*key).agg(F.sum("MWh").alias("MWh"))
    return total.join(cap, key, "inner").withColumn("CF", S.ratio("MWh", F.col("MW") * S.HOURS_PER_YEAR))


def renewables_and_storage(gen: DataFrame, stor: DataFrame) -> DataFrame:
    """Wind, solar, storage and battery energy side by side per year (TWh)."""
    tech = F.col("technology")
    g = gen.filter(tech.startswith("wind") | tech.rlike("upv|distpv")).groupBy("year").agg(
        F.sum(F.when(tech.startswith("wind"), F.col("Generation (TWh)"))).alias("Wind (TWh)"),
        F.sum(F.when(tech.rlike("upv|distpv"), F.col("Generation (TWh)"))).alias("PV (TWh)"))
    s = stor.filter(F.col("type") == "in").groupBy("year").agg(
        F.sum("Storage (TWh)").alias("Storage (TWh)"),
        F.sum(F.when(tech.startswith("battery"), F.col("Storage (TWh)"))).alias("Battery (TWh)"))
    d = reshape.side_by_side("year", [g, s])
    for c in ("Wind (TWh)", "PV (TWh)", "Storage (TWh)", "Battery (TWh)"):
        d = d.withColumn(c, F.col(c) / 1e6)
    return d.withColumn("VRE (TWh)", F.col("Wind (TWh)") + F.col("PV (TWh)"))


def storage_capacity(cap: DataFrame, bcr: DataFrame, energy: DataFrame, region_map: DataFrame) -> DataFrame:
    """Storage power (GW) and energy (GWh); a missing battery ratio counts as one."""
    total = energy.groupBy("tech", "rb", "year").agg((F.sum("Energy (GWh)") / 1e3).alias("Energy (GWh)"))
    d = joins.left_fill(joins.keep_members(cap, total, "tech"), bcr, ["tech"], "bcr", 1.0)
    d = d.withColumn("Capacity (GW)", F.col("Capacity (GW)") * F.col("bcr") / 1e3)
    return to_balancing_area(d, region_map).join(total, ["tech", "rb", "year"], "inner")


def runtime(table: DataFrame) -> DataFrame:
    """Process hours from a table with named text columns; year 0 counts as 2000."""
    d = table.select(S.to_number("year").cast("int").alias("year"), "process",
                     (S.to_number("processtime") / 3600).alias("processtime"))
    d = d.filter(F.col("processtime").isNotNull())
    return d.withColumn("year", S.replace_value("year", 0, 2000))


def net_emissions(emit: DataFrame) -> DataFrame:
    """Emissions and their running total by pollutant and technology (millions)."""
    y = "CO2e (MMton)"
    d = windows.running_sum(emit, y, ["e", "tech"], ["year"], f"Cumulative {y}")
    return project.scale(project.scale(d, y, 1e-6), f"Cumulative {y}", 1e-6)


DAMAGE, LIVES = "Health damages (billion $)", "Health damages (lives)"
TONNES, DISC_DAMAGE = "Emissions (thousand tonnes)", "Discounted health damages (billion $)"
HEALTH_KEY = ["model", "cr", "e", "rb"]


def health_damage(df: DataFrame, money: Money = Money()) -> DataFrame:
    """Yearly damages by pollutant with totals over pollutants; missing years are carried forward."""
    d = (df.withColumn(DAMAGE, money.inflate(DAMAGE) * 1e-9)
           .withColumn(TONNES, F.col(TONNES) * 1e-3)
           .withColumn(DISC_DAMAGE, money.discount(DAMAGE)))
    first, last = df.agg(F.min("year")).scalar(), df.agg(F.max("year")).scalar()
    axis = joins.expand_years(aggregate.grid(df, HEALTH_KEY), first, last)
    full = axis.join(d, [*HEALTH_KEY, "year"], "left")
    measures = [TONNES, DAMAGE, LIVES, DISC_DAMAGE]
    for m in measures:
        full = windows.ffill(full, m, HEALTH_KEY, ["year"])
    def zero_sum(c, out):
        return F.coalesce(F.sum(c), F.lit(0.0)).alias(out)
    one = full.groupBy("model", "cr", "e", "year").agg(*[zero_sum(m, m) for m in measures])
    total = full.groupBy("model", "cr", "year").agg(
        zero_sum(DAMAGE, "Total health damages (billion $)"), zero_sum(LIVES, "Total health damages (lives)"),
        zero_sum(DISC_DAMAGE, "Total discounted health damages (billion $)"))
    return one.join(total, ["model", "cr", "year"], "outer")


def social_cost(system: DataFrame, health: DataFrame) -> DataFrame:
    """System cost and health cost per year and per MWh, one row per cost type.

    ``system`` comes from the national average price, ``health`` from :func:`health_damage`.
    """
    s = system.groupBy("year").agg(F.sum("Cost (Bil $)").alias("s_cost"),
                                   F.sum("Discounted Cost (Bil $)").alias("s_disc"), F.avg("q").alias("q"))
    h = health.groupBy("year", "model", "cr").agg(F.sum(DAMAGE).alias("h_cost"), F.sum(DISC_DAMAGE).alias("h_disc"))
    both = s.join(h, "year", "outer")
    pair = F.array(
        F.struct(F.lit("System cost").alias("cost_type"), F.col("s_cost").alias("cost"), F.col("s_disc").alias("disc")),
        F.struct(F.lit("System cost + health").alias("cost_type"), F.col("h_cost").alias("cost"), F.col("h_disc").alias("disc")))
    d = both.select("year", "model", "cr", "q", F.inline(pair))
    return d.select("year", "model", "cr", "q", "cost_type", F.col("cost").alias("Cost (Bil $)"),
                    F.col("disc").alias("Discounted Cost (Bil $)"),
                    S.ratio(F.col("cost") * 1e9, "q").alias("Average cost ($/MWh)"),
                    S.ratio(F.col("disc") * 1e9, "q").alias("Discounted average cost ($/MWh)"))


def spur_lines(miles: DataFrame, firm_miles: DataFrame, new_bins: DataFrame, distances: DataFrame,
               ignore_spur: bool = False) -> DataFrame:
    """Transmission GW-miles with the running total of spur lines as one more type."""
    amount, firm = "Amount (GW-mi)", "Trans cap, PRM (GW-mi)"
    d = miles.join(firm_miles, ["trtype", "year"], "outer")
    d = d.withColumn(amount, F.col(amount) / 1000).withColumn(firm, F.col(firm) / 1000)
    if ignore_spur:
        return d
    starts = F.lit(False)
    for t in SPUR_TECHS:
        starts = starts | F.col("i").startswith(t)
    built = (new_bins.filter(starts).groupBy("i", "r", "rscbin", "year").agg(F.sum("MW").alias("MW"))
             .join(distances, ["i", "r", "rscbin"], "left")
             .groupBy("year").agg(F.sum(F.col("MW") * F.col("dist_km") / S.KM_PER_MILE / 1000).alias("__add")))
    years = d.select("year").distinct().join(built, "year", "left")
    spur = windows.running_sum(years.withColumn("__add", F.coalesce("__add", F.lit(0.0))).withColumn("trtype", F.lit("spur")),
                               "__add", ["trtype"], ["year"], amount)
    return reshape.union_by_name(d, spur.select("trtype", "year", amount))
