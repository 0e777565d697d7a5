from pyspark.sql import functions as F
from tidebook.llm import fingerprints as P


def test_likeness_when_no_sketch_peels(spark, monkeypatch):
    monkeypatch.setattr(P, "SIZES", P.SIZES[:1])
    lines = [f"line {i}" for i in range(2000)]
    other = lines[:1000] + [f"other {i}" for i in range(1000)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "x string, y string")
    df = df.select(P.digests(F.col("x")).alias("a"), P.digests(F.col("y")).alias("b"))
    df = df.select("a", "b", *[P.sketch(F.col(c), P.SIZES[0]).alias(f"{c}_cells") for c in "ab"])
    df = P.with_difference(df, "d", "a", "b", "a_cells", "b_cells")
    row = df.select(F.size(F.col("d")["cells"]).alias("left"), P.likeness("d", "a", "b").alias("near")).first()
    assert row["left"] > 0 and row["near"] == 0.5
