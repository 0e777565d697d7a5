"""Fixed-width text reports from small metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_folds(metrics: DataFrame, key: str = "horizon") -> DataFrame:
    """Mean and population deviation of every numeric metric over folds, by horizon."""
    names = [c for c, t in metrics.dtypes if c not in (key, "fold") and t in ("double", "float", "int", "bigint")]
    return metrics.groupBy(key).agg(*[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_pop(c).alias(f"{c}_std") for c in names])


def as_text(df: DataFrame, title: str, order: Sequence[str], width: int = 16, digits: int = 6) -> str:
    """Format a metrics table (a row a horizon or arm: small by construction)."""
    head = "".join(f"{c:>{max(width, len(c) + 2)}}" for c in df.columns)
    lines = [title, "=" * len(head), head, "-" * len(head)]
    for row in df.orderBy(*order).collect():
        lines.append("".join(f"{(format(v, f'.{digits}f') if isinstance(v, float) else str(v)):>{max(width, len(c) + 2)}}" for c, v in row.asDict().items()))
    return "\n".join(lines) + "\n"


def write_text(df: DataFrame, path: str, title: str, order: Sequence[str]) -> str:
    """Write the report through the file system of ``path`` and return it."""
    spark, text = df.sparkSession, as_text(df, title, order)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text
