"""Event study: forward paths, event classes, lift over noise, day-block bootstrap, stability checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.expr import safe_div
from tidebook.functions.windows import ahead, gated, lag, lead, series


def with_forward_path(df: DataFrame, price: str, rows: int, keys: Sequence[str] = ("symbol", "date"), order: str = "ts_event") -> DataFrame:
    """Adds R_end, R_high, R_low, RV_fwd and RV_trail in basis points over the next (last) ``rows`` rows."""
    w = series(keys, order)
    p = F.when(F.col(price) > 0, F.col(price))
    x = F.ln(p)
    before = lag(F.struct(x.alias("x")), 1, w)
    df = df.withColumn("__r2", F.when(before.isNull(), F.lit(0.0)).otherwise(F.pow(x - before["x"], F.lit(2.0))))

    def bps(there: Column) -> Column:
        return (safe_div(there, p) - 1.0) * 1e4

    return df.withColumns({
        "R_end": bps(lead(price, rows, w)),
        "R_high": bps(ahead(F.max, price, rows, w)),
        "R_low": bps(ahead(F.min, price, rows, w)),
        "RV_fwd": F.sqrt(ahead(F.sum, "__r2", rows, w)) * 1e4,
        "RV_trail": F.sqrt(gated(F.sum, "__r2", rows, 1, w)) * 1e4,
    }).drop("__r2")


def event_class(theta: float | Column, rho: float = 2.0, in_session: Column | None = None) -> Column:
    """1 strong up, 2 strong down, 3 reversion, 4 expansion, 5 contraction of volatility, else 0; the first that holds."""
    theta = F.lit(float(theta)) if isinstance(theta, (int, float)) else theta
    session = F.lit(True) if in_session is None else in_session
    end, high, low = F.col("R_end"), F.col("R_high"), F.col("R_low")
    path = session & end.isNotNull() & high.isNotNull() & low.isNotNull()
    ratio = safe_div("RV_fwd", F.greatest(F.col("RV_trail"), F.lit(1e-12)))
    vol = session & F.col("RV_fwd").isNotNull() & (F.col("RV_trail") > 0)
    out = F.when(path & (high >= theta) & (low >= -theta * 0.5) & (end >= theta * 0.5), 1)
    out = out.when(path & (low <= -theta) & (high <= theta * 0.5) & (end <= -theta * 0.5), 2)
    out = out.when(path & (F.greatest(high, -low) >= theta) & (F.abs(end) <= theta * 0.3), 3)
    return out.when(vol & (ratio >= rho), 4).when(vol & (ratio <= 1.0 / rho), 5).otherwise(0)


def lift_over_noise(df: DataFrame, descriptor: str, forward: str, tail: float = 0.10, least_pool: int = 500, least_triggers: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """A row for each direction (and ``by``): how far triggered forward values lie from the pool's mean, in pool
    deviations. Triggers are the descriptor's tails. Too small a pool or too few triggers give no row.

    Two aggregates: exact tail quantiles (one row a group, joined back), then conditional moments."""
    d, f = F.col(descriptor).cast("double"), F.col(forward).cast("double")

    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    pool = df.select(*by, d.alias("__d"), f.alias("__f")).where(fine(F.col("__d")) & fine(F.col("__f")))
    ends = pool.groupBy(*by).agg(F.percentile("__d", F.array(F.lit(1 - tail), F.lit(tail))).alias("__q"))
    both = pool.join(ends, list(by)) if by else pool.crossJoin(F.broadcast(ends))
    sides = F.array(F.struct(F.lit("long").alias("direction"), (F.col("__d") >= F.col("__q")[0]).alias("hit"), F.lit(1.0).alias("sign")), F.struct(F.lit("short").alias("direction"), (F.col("__d") <= F.col("__q")[1]).alias("hit"), F.lit(-1.0).alias("sign")))
    long = both.withColumn("__s", F.explode(sides)).select(*by, "__f", "__s.*")
    hit = F.when(F.col("hit"), F.col("__f"))
    out = long.groupBy(*by, "direction").agg(
        F.count(F.lit(1)).alias("n_baseline"), F.count(hit).alias("n_triggers"), F.avg("__f").alias("baseline_mean"), F.stddev_samp("__f").alias("baseline_std"),
        F.avg(hit).alias("trigger_mean"), F.avg(F.when(F.col("hit"), (F.signum("__f") == F.col("sign")).cast("double"))).alias("hit_rate_sign"),
    )
    out = out.where((F.col("n_baseline") >= least_pool) & (F.col("n_triggers") >= least_triggers) & (F.col("baseline_std") > 0))
    return out.withColumns({"trig_pct": 100.0 * F.col("n_triggers") / F.col("n_baseline"), "lift_std_units": safe_div(F.col("trigger_mean") - F.col("baseline_mean"), "baseline_std")})


def random_draws(days: DataFrame, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """(boot, day): for each resample as many days, drawn with replacement, as ``days`` (column day, distinct) has.
    Draws hash (seed, boot, place), so they don't depend on partitions."""
    listed = days.select("day").distinct().withColumn("__i", F.row_number().over(Window.orderBy("day")) - 1)
    n = listed.agg(F.count(F.lit(1)).alias("__n"))
    grid = days.sparkSession.range(n_boot).withColumnRenamed("id", "boot").crossJoin(F.broadcast(n)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0)).cast("int"))))
    drawn = grid.withColumn("__i", F.pmod(F.xxhash64(F.lit(seed), "boot", "__k"), F.col("__n")).cast("int"))
    return drawn.join(F.broadcast(listed), "__i").select("boot", "day")


def bootstrap_lift(triggered: DataFrame, draws: DataFrame, base_mean: float, base_std: float, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """One row: percentiles of the lift over day-block resamples. ``triggered`` has (day, value); a drawn day brings
    all its values, through its count and sum. Fewer than 10 usable resamples or no spread give nulls."""
    per_day = triggered.where("value is not null").groupBy("day").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    lifts = draws.join(F.broadcast(per_day), "day").groupBy("boot").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    lifts = lifts.select(((F.col("s") / F.col("n") - F.lit(float(base_mean))) / F.lit(float(base_std) if base_std > 0 else None).cast("double")).alias("lift"))
    names = ("ci_low", "median", "ci_high")
    q = F.percentile("lift", F.array(F.lit(low / 100), F.lit(0.5), F.lit(high / 100)))
    return lifts.agg(F.count("lift").alias("n_boot"), q.alias("q")).select("n_boot", *[F.when(F.col("n_boot") >= 10, F.col("q")[i]).alias(n) for i, n in enumerate(names)])


def stability(per_day: DataFrame, base_mean: float, base_std: float, aggregate_lift: float, least_share: float = 0.60, most_drop: float = 0.50, least_per_day: int = 3, least_days: int = 6, least_ratio: float = 0.40) -> DataFrame:
    """One row of checks over (day_index, n, s): same sign in both halves (A), halves of like size (B), share of days
    of the right sign (C), no day that carries the lift (D), no dead day (F). Totals and halves are window sums."""
    m, sd, lift = F.lit(float(base_mean)), F.lit(float(base_std) if base_std > 0 else None).cast("double"), float(aggregate_lift)
    whole = Window.partitionBy()  # a row a day
    n_days = F.count(F.lit(1)).over(whole)
    rows = per_day.withColumns({"__days": n_days, "__n": F.sum("n").over(whole), "__s": F.sum("s").over(whole), "__first": F.row_number().over(Window.orderBy("day_index")) <= F.floor(n_days / 2)})
    own = safe_div(safe_div("s", "n") - m, sd)
    without = safe_div(safe_div(F.col("__s") - F.col("s"), F.col("__n") - F.col("n")) - m, sd)
    drop = F.when((F.col("n") > 0) & (F.col("__n") - F.col("n") > 0), 1.0 - F.abs(without) / F.lit(abs(lift) if abs(lift) > 1e-9 else None).cast("double"))

    def half(first: bool) -> Column:
        mine = F.col("__first") if first else ~F.col("__first")
        n, s = F.sum(F.when(mine, F.col("n")).otherwise(0)), F.sum(F.when(mine, F.col("s")).otherwise(0.0))
        return F.when(n > 0, safe_div(safe_div(s, n) - m, sd))

    right = (F.signum(own) == F.lit(1.0 if lift >= 0 else -1.0)).cast("double")
    out = rows.agg(F.max("__days").alias("n_days"), half(True).alias("half1"), half(False).alias("half2"), F.avg(F.when(F.col("n") > 0, right)).alias("frac_days_correct"), F.greatest(F.max(drop), F.lit(0.0)).alias("max_jackknife_drop"), F.min("n").alias("__least"))
    both = F.col("half1").isNotNull() & F.col("half2").isNotNull()
    ratio = F.when(F.abs("half1") > 1e-9, F.abs("half2") / F.abs("half1"))
    a = F.coalesce(both & (F.signum("half1") == F.signum("half2")), F.lit(False))
    usable = F.lit(base_std > 0)
    out = out.withColumns({"pass_A": a & usable, "magnitude_ratio": F.when(a & (F.col("n_days") >= least_days), ratio)})
    out = out.withColumns({
        "pass_B": F.when(both & (F.col("n_days") >= least_days), F.coalesce(F.col("pass_A") & (F.col("magnitude_ratio") >= least_ratio), F.lit(False))).otherwise(F.lit(True)),
        "pass_C": F.coalesce(F.col("frac_days_correct") >= least_share, F.lit(False)) & usable,
        "pass_D": F.coalesce(F.col("max_jackknife_drop") <= most_drop, F.lit(False)) & F.lit(abs(lift) > 1e-9) & usable,
        "pass_F": (F.col("__least") >= least_per_day) & usable,
    })
    return out.withColumn("pass_all", F.col("pass_A") & F.col("pass_B") & F.col("pass_C") & F.col("pass_D") & F.col("pass_F")).drop("__least")
