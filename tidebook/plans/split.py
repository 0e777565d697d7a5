"""A split of the modelling table as one dense (time, node) panel, and the graphs of its windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.expr import repaired
from tidebook.operators import network
from tidebook.operators.graph import dynamic_edges
from tidebook.operators.panel import dense_panel, forward_filled, scaled_targets, standardised, target_scales, time_index, train_stats
from tidebook.operators.targets import seasonality
from tidebook.sources.cache import written

#: Channels beside the features.
CHANNELS = ("stale", "tod_sin", "tod_cos", "frac_open", "frac_close", "auction")


@dataclass(frozen=True)
class Split:
    """panel: a row a time and node; feature_stats and scales: one row each, to be handed to a test split."""

    panel: DataFrame
    feature_stats: DataFrame
    scales: DataFrame


def prepare_split(df: DataFrame, base: Sequence[str], targets: Sequence[str], assets: Sequence[str], macros: Sequence[str] = (), feature_stats: DataFrame | None = None, scales: DataFrame | None = None, time: str = "ts_event") -> Split:
    """Rows of ``df`` (time, date, symbol, ret_bps, base, targets; for each macro source P: P_ret_bps, P_{base},
    P_stale_flag) as a panel of every time and node.

    panel: time, ti, day, node, kind ("equity" or "macro"), present, the CHANNELS, base in training units clipped to
    10, ret (the return at that very time, else 0), spread, liquidity and residual (raw, for the graphs; 1, 1 and 0
    where there is no such feature), targets in training deviations clipped to 8, {target}_raw and target_valid.
    An equity's missing features are filled forward, through days, and are 0 before its first; its stale channel says
    that the row is missing. A source's values are those of its time's row of least symbol. Without ``feature_stats``
    and ``scales`` this is the training split, and they are taken from it: features over all nodes and times, targets
    over rows whose targets are all finite. Rows of other symbols than ``assets`` count for times only."""
    spark = df.sparkSession
    base, targets = list(base), list(targets)
    clean = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in dict.fromkeys([*base, *targets, "ret_bps"])})
    # the grid, its times, the equities' and the sources' rows read it: written once
    clean = written(clean.withColumn("__ret", F.col("ret_bps")), "split-rows")
    nodes = spark.createDataFrame([(a,) for a in assets], "symbol string")
    panel = forward_filled(dense_panel(clean, nodes, [*base, "__ret", *targets], time), base)
    panel = panel.select(time, "ti", "day", F.col("symbol").alias("node"), F.lit("equity").alias("kind"), "present", (~F.col("present")).cast("double").alias("stale"), *base, F.coalesce("__ret", F.lit(0.0)).alias("ret"), *targets)
    if macros:
        none = [F.lit(None).cast("double").alias(t) for t in targets]
        found = [F.struct(F.lit(p).alias("node"), F.col(f"{p}_stale_flag").cast("double").alias("stale"), *[F.nanvl(F.col(f"{p}_{c}").cast("double"), F.lit(None).cast("double")).alias(c) for c in base], repaired(F.col(f"{p}_ret_bps").cast("double")).alias("ret")) for p in macros]
        rows = clean.select(time, "symbol", F.array(*found).alias("__m")).groupBy(time).agg(F.min_by("__m", "symbol").alias("__m"))
        rows = rows.join(time_index(clean, time), time).select(time, "ti", "day", F.explode("__m").alias("__m")).select(time, "ti", "day", "__m.*")
        panel = panel.unionByName(rows.select(time, "ti", "day", "node", F.lit("macro").alias("kind"), F.lit(False).alias("present"), "stale", *base, "ret", *none))
    # read by both statistics and by the panel: written once
    panel = written(panel, "split")
    feature_stats = train_stats(panel, base) if feature_stats is None else feature_stats
    scales = target_scales(panel, targets) if scales is None else scales
    residual = next((c for c in base if "kalman_z_score" in c), None)
    raw = {"spread": "spread_bps", "liquidity": "top5_book_size"}
    extra = {k: repaired(F.col(c)) if c in base else F.lit(1.0) for k, c in raw.items()} | {"residual": repaired(F.col(residual)) if residual else F.lit(0.0)}
    out = seasonality(panel.withColumns(extra | {f"{t}_raw": F.coalesce(t, F.lit(0.0)) for t in targets}), time)
    out = scaled_targets(standardised(out, feature_stats, base), scales, targets)
    kept = [time, "ti", "day", "node", "kind", "present", *CHANNELS, *base, "ret", *extra, *targets, *[f"{t}_raw" for t in targets], "target_valid"]
    return Split(out.select(*kept), feature_stats, scales)


def split_graphs(split: DataFrame, sectors: DataFrame, seq: int, threshold: float = 0.2, top_k: int = 8, market: str | None = None, ablate: bool = False) -> DataFrame:
    """The edges of a graph at every window end of a split's panel: the last ``seq`` rows lie in the day and some
    target there is valid. sectors: (node, sector)."""
    panel = split.select("ti", "day", "node", "ret", F.col("target_valid").alias("valid"))
    nodes = split.select(F.col("ti").alias("te"), "node", "kind", "spread", "liquidity", "residual").join(F.broadcast(sectors.select("node", "sector")), "node", "left")
    return dynamic_edges(panel, nodes, None, threshold, top_k, market, ablate=ablate, seq=seq)


def graph_scores(fitted: Split, tested: Split, sectors: DataFrame, base: Sequence[str], targets: Sequence[str], seq: int = 30, hidden: int = 32, epochs: int = 3, batch: int = 16, seed: int = 0, **graphs) -> DataFrame | None:
    """(te, node, horizon, score) for every equity at every window end of ``tested``, by a graph network trained on
    ``fitted``; None with fewer than ``batch`` windows there. Scores are in training deviations of the targets."""
    channels = [*CHANNELS, *base]
    shape = network.Shape(len(channels), hidden, len(targets))

    def rows(split: Split) -> DataFrame:
        edges = written(split_graphs(split.panel, sectors, seq, **graphs), "graphs")
        return network.windows(split.panel, edges, channels, targets, seq)

    weights = network.train(rows(fitted), shape, epochs, batch, seed=seed)
    if weights is None:
        return None
    equities = tested.panel.where("kind = 'equity'").select(F.col("ti").cast("long").alias("te"), "node")
    return network.predict(rows(tested), shape, weights).join(equities, ["te", "node"])
