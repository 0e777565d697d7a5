"""A tick table derived from the ``events`` test table, and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH_S = 300
WIDTH_US = WIDTH_S * 1_000_000
LEVELS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    """Microseconds since the epoch of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    out = {
        "symbol": F.concat(F.lit("S"), F.pmod("user_id", F.lit(8)).cast("string")),
        "sequence": F.col("event_id"),
        "ts_us": micros("ts"),
        "size": (F.col("event_id") % 97 + 1).cast("double"),
        "action": F.when(kind.isin("click", "signup"), "A").when(kind.isin("view", "error"), "C").when(kind == "purchase", "T"),
        "side": F.when(F.col("event_id") % 2 == 0, "B").otherwise("A"),
    }
    for i in range(LEVELS):
        out |= {
            f"bid_px_{i:02d}": F.col("value") - F.lit(0.01 * (i + 1)), f"ask_px_{i:02d}": F.col("value") + F.lit(0.01 * (i + 1)),
            f"bid_sz_{i:02d}": ((F.col("event_id") * 7 + i * 13) % 100 + 1).cast("double"), f"ask_sz_{i:02d}": ((F.col("event_id") * 11 + i * 17) % 100 + 1).cast("double"),
        }
    return e.select(*[v.alias(k) for k, v in out.items()])


BOOK = [f"{s}_{w}_{i:02d}" for i in range(LEVELS) for s, w in (("bid", "px"), ("ask", "px"), ("bid", "sz"), ("ask", "sz"))]


def _level_sql(i: int) -> str:
    d = repr(0.01 * (i + 1))
    return f"value - {d}::DOUBLE AS bid_px_{i:02d}, value + {d}::DOUBLE AS ask_px_{i:02d}, ((event_id*7+{i * 13})%100+1)::DOUBLE AS bid_sz_{i:02d}, ((event_id*11+{i * 17})%100+1)::DOUBLE AS ask_sz_{i:02d}"


TICKS_SQL = f"""ticks AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, event_id AS sequence, epoch_us(ts) AS ts_us, (event_id % 97 + 1)::DOUBLE AS size,
 CASE WHEN event_type IN ('click','signup') THEN 'A' WHEN event_type IN ('view','error') THEN 'C' WHEN event_type = 'purchase' THEN 'T' END AS action,
 CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, {", ".join(map(_level_sql, range(LEVELS)))} FROM events)"""

_FLOW = ", ".join(f"coalesce(sum(size) FILTER (WHERE action='{a}' AND side='{s}'), 0.0) AS {n}" for a, s, n in (("A", "B", "size_added_bid"), ("A", "A", "size_added_ask"), ("C", "B", "size_canceled_bid"), ("C", "A", "size_canceled_ask"), ("T", "B", "trade_size_buy"), ("T", "A", "trade_size_sell")))
FLOW_NAMES = ("size_added_bid", "size_added_ask", "size_canceled_bid", "size_canceled_ask", "trade_size_buy", "trade_size_sell")
_BAR = f"ts_us - ts_us % {WIDTH_US}"

BARS_SQL = f"""{TICKS_SQL},
flows AS (SELECT symbol, {_BAR} AS ts_event, count(*) AS msg_count, {_FLOW} FROM ticks GROUP BY ALL),
lasts AS (SELECT symbol, {_BAR} AS ts_event, {", ".join(BOOK)} FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, {_BAR} ORDER BY ts_us DESC, sequence DESC) = 1),
bars AS (SELECT symbol, ts_event, ts_event // 86400000000 AS date, {", ".join(BOOK)}, msg_count, {", ".join(FLOW_NAMES)} FROM flows JOIN lasts USING (symbol, ts_event))"""

_FILL = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in BOOK)
DENSE_SQL = f"""{BARS_SQL},
ends AS (SELECT symbol, date, min(ts_event) AS lo, max(ts_event) AS hi FROM bars GROUP BY ALL),
grid AS (SELECT symbol, date, unnest(generate_series(lo, hi, {WIDTH_US}::BIGINT)) AS ts_event FROM ends),
dense AS (SELECT g.symbol, g.ts_event, g.date, {_FILL}, coalesce(msg_count, 0) AS msg_count, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in FLOW_NAMES)}
 FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts_event = b.ts_event WINDOW w AS (PARTITION BY g.symbol, g.date ORDER BY g.ts_event ROWS UNBOUNDED PRECEDING))"""
