"""``spark-submit -m tidebook`` or ``python -m tidebook``: ticks to features, folds, scores and a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidebook.operators.features import model_columns
from tidebook.operators.targets import HORIZONS, TARGETS
from tidebook.plans import walk_forward as WF
from tidebook.plans.dataset import barred, build_dataset, featured
from tidebook.sources.cache import build_cache, read_days
from tidebook.sources.ticks import files_for_days, list_days, read_ticks


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidebook", description=__doc__)
    p.add_argument("--equities", required=True, help="glob of tick files; a file name holds its day")
    p.add_argument("--source", action="append", default=[], metavar="NAME=GLOB", help="a futures source to join as of each row")
    p.add_argument("--cache", required=True, help="directory of the per-day cache")
    p.add_argument("--rebuild-cache", action="store_true")
    p.add_argument("--stream", action="store_true", help="folds of whole days instead of purged time folds")
    p.add_argument("--n-splits", type=int, default=4)
    p.add_argument("--train-days", type=int, default=0)
    p.add_argument("--test-days", type=int, default=2)
    p.add_argument("--purge-seconds", type=int, default=900)
    p.add_argument("--warmup-seconds", type=int, default=900)
    p.add_argument("--include-extended", action="store_true", help="keep rows outside the session")
    p.add_argument("--model", choices=("trees", "huber"), default="trees")
    p.add_argument("--trees", type=int, default=20)
    p.add_argument("--mm", action="store_true", help="run the market maker too")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--buffer", type=int)
    p.add_argument("--band", type=float, default=0.0)
    p.add_argument("--edge-gate", type=float, default=0.0)
    p.add_argument("--cost-bps", type=float, default=0.0, help="cost a trade beside the half spread")
    p.add_argument("--session", nargs=2, type=int, default=(48600, 72000), metavar=("FROM", "TO"), help="seconds of the day, UTC")
    p.add_argument("--mm-kappa", type=float, default=0.25)
    p.add_argument("--mm-limit", type=float, default=5.0)
    p.add_argument("--mm-skew", type=float, default=0.5)
    p.add_argument("--mm-gate", type=float, default=0.0)
    p.add_argument("--mm-fee-bps", type=float, default=0.0)
    p.add_argument("--output", default="output.txt")
    return p


def main(argv: list[str] | None = None) -> str:
    a = options().parse_args(argv)
    spark = SparkSession.builder.appName("tidebook").getOrCreate()
    sources = dict(s.split("=", 1) for s in a.source)

    def day(d: str):
        read = lambda pattern: read_ticks(spark, files_for_days(spark, pattern, [d])).withColumn("ts_us", _micros())
        of = lambda pattern: featured(read(pattern), 1_000_000)
        macros = {}
        for name, pattern in sources.items():
            try:
                macros[name] = of(pattern)
            except FileNotFoundError as e:
                print(f"warning: {name}: {e}")
        return build_dataset(of(a.equities), macros, warm_up_seconds=a.warmup_seconds, session=None if a.include_extended else tuple(a.session), times=barred(read(a.equities), 1_000_000))

    build_cache(spark, list_days(spark, a.equities), day, a.cache, a.rebuild_cache)
    df = read_days(spark, a.cache)
    tagged = WF.tagged_days(df, a.train_days, a.test_days) if a.stream else WF.tagged_folds(df, a.n_splits, a.purge_seconds * 1_000_000, a.train_days)
    model = {"trees": a.trees} if a.model == "trees" else {}
    scored = WF.predictions(tagged, model_columns(df.columns, tuple(sources)), [t for t in TARGETS if t in df.columns], a.model, **model)
    if scored is None:
        raise SystemExit("no fold has enough rows")
    ends = {h: e for h, (_, e) in enumerate(HORIZONS)}
    portfolio, makers = WF.simulations(scored, {h: max(1, e) for h, e in ends.items()}, a.top_k, a.buffer, a.band, a.edge_gate, extra_cost_bps=a.cost_bps, kappa=a.mm_kappa, inventory_limit=a.mm_limit, skew=a.mm_skew, maker_gate=a.mm_gate, fee_bps=a.mm_fee_bps)
    text = WF.report(WF.signal_metrics(scored, overlap=ends), portfolio, makers if a.mm else None)
    target = spark._jvm.org.apache.hadoop.fs.Path(a.output)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text


def _micros():
    from pyspark.sql import functions as F

    return F.expr("ts_event div 1000")


if __name__ == "__main__":
    print(main())
