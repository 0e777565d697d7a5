"""From raw ticks to the modelling table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.expr import not_null
from tidebook.operators.asof import asof_join
from tidebook.operators.bars import make_bars
from tidebook.operators.features import extract_features, model_columns
from tidebook.operators.targets import HORIZONS, TARGETS, after_warm_up, in_session, with_targets
from tidebook.sources.ticks import clean_ticks

#: The futures that equities are read against.
SOURCES = ("ES", "NQ", "CL", "BZ", "NG", "GC", "SI", "HG")


def barred(ticks: DataFrame, width_us: int, keys: Sequence[str] = ("ts_event", "symbol", "sequence"), scale: bool = True, time_us="ts_us") -> DataFrame:
    """Clean ticks as dense bars."""
    return make_bars(clean_ticks(ticks, keys, scale), width_us, time_us=time_us)


def featured(ticks: DataFrame, width_us: int, keys: Sequence[str] = ("ts_event", "symbol", "sequence"), scale: bool = True, time_us="ts_us") -> DataFrame:
    """Clean ticks, dense bars, features over the whole session."""
    return extract_features(barred(ticks, width_us, keys, scale, time_us))


def build_dataset(equities: DataFrame, sources: Mapping[str, DataFrame], width_us: int = 1_000_000, warm_up_seconds: int = 900, session: tuple[int, int] | None = (48600, 72000), horizons=HORIZONS, times: DataFrame | None = None) -> DataFrame:
    """The modelling table of feature frames (see ``featured``). ``times`` (date, ts_event), where given, has at least
    the equities' times, so that these frames aren't computed again for them.

    Warm-up and session filters come after the features, so windows are warm, and before the targets, so no target
    sees beyond the session. Each source's model columns are joined as of each row; missing source values become 0;
    rows without every feature or target go (null, not NaN)."""
    df = after_warm_up(equities, warm_up_seconds)
    if session is not None:
        df = df.where(in_session("ts_event", *session))
    df = with_targets(df, horizons=horizons, width_us=width_us)
    base = model_columns(df.columns, tuple(sources))
    targets = [c for c in df.columns if c in TARGETS or c.startswith("ret_") and c.endswith("s") and c not in ("ret_bps",)]
    for prefix, frame in sources.items():
        columns = model_columns(frame.columns)
        df = asof_join(df, frame, prefix, columns, times=times)
        df = df.withColumns({f"{prefix}_{c}": F.coalesce(F.nanvl(f"{prefix}_{c}", F.lit(0.0)), F.lit(0.0)) for c in columns})
    return df.where(not_null([*base, *targets]))


def summary(df: DataFrame) -> DataFrame:
    """Dates, symbols and rows of a dataset."""
    return df.agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"), F.count(F.lit(1)).alias("n_rows"))
