"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text's paragraphs are its lines, lines of over WORDS words cut every WORDS words. The distinct 64-bit digests go to
one cell in each of three subtables; a cell keeps a count, the exclusive or of its digests and of their checks.
Sketches are kept sparse: only cells that hold something, in order. Subtracting two sketches leaves the paragraphs in
which the texts differ; peeling takes out cells that hold one digest until none is left. A sketch too small for the
difference fails, and the next size is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.runtime import id_text, partitions

WORDS = 48
#: Cells of one of the three subtables: the fingerprint's size, then the sizes tried after a failure.
SIZES = (16, 64, 256, 1024, 4096, 16384)
#: Peeling rounds at most; a difference that fits is peeled in far fewer.
ROUNDS = 48
SHIFTS = (0, 20, 40)
PARAGRAPH = rf"\S{{1,64}}(?:[^\S\n]+\S{{1,64}}){{0,{WORDS - 1}}}"
CELLS = "array<struct<i:int,c:int,k:bigint,x:bigint>>"


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(key: Column, sign: Column, size: int) -> Column:
    """The digest's cell in each subtable."""
    at = [(F.shiftrightunsigned(key, s).bitwiseAND(F.lit(size - 1)) + n * size).cast("int") for n, s in enumerate(SHIFTS)]
    return F.array(*[F.struct(i.alias("i"), sign.cast("int").alias("c"), key.alias("k"), _check(key).alias("x")) for i in at])


def _merged(entries: Column) -> Column:
    """Cells from entries: those of one place add up, and what cancels goes."""
    nothing = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("x"))

    def close(acc: Column) -> Column:
        cur = acc["cur"]
        return F.when((cur["c"] != 0) | (cur["k"] != 0) | (cur["x"] != 0), F.concat(acc["done"], F.array(cur))).otherwise(acc["done"])

    def add(acc: Column, e: Column) -> Column:
        cur = acc["cur"]
        both = F.struct(e["i"].alias("i"), (cur["c"] + e["c"]).alias("c"), cur["k"].bitwiseXOR(e["k"]).alias("k"), cur["x"].bitwiseXOR(e["x"]).alias("x"))
        same = cur["i"] == e["i"]
        return F.struct(F.when(same, acc["done"]).otherwise(close(acc)).alias("done"), F.when(same, both).otherwise(e).alias("cur"))

    start = F.struct(F.array().cast(CELLS).alias("done"), nothing.alias("cur"))
    return F.aggregate(F.array_sort(entries), start, add, close)


def sketch(keys: Column, size: int, sign: int = 1) -> Column:
    return _merged(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(sign), size))))


def _negative(cells: Column) -> Column:
    return F.transform(cells, lambda e: F.struct(e["i"].alias("i"), (-e["c"]).alias("c"), e["k"].alias("k"), e["x"].alias("x")))


def peeled(cells: Column, size: int) -> Column:
    """What subtraction left, peeled: the cells that remain (none: success) and the signed digests that came out."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<s:int,k:bigint>>").alias("found"))

    def one_round(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(state["cells"], lambda e: (F.abs(e["c"]) == 1) & (_check(e["k"]) == e["x"])), lambda e: F.struct(e["c"].alias("s"), e["k"].alias("k"))))

        def take(found: Column) -> Column:
            out = F.flatten(F.transform(found, lambda p: _entries(p["k"], -p["s"], size)))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(_merged(F.concat(state["cells"], out)).alias("cells"), F.concat(state["found"], found).alias("found")))

        # binds the round's digests to a name, so that they are computed once
        return F.when(F.size(state["cells"]) == 0, state).otherwise(F.transform(F.array(pure), take)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def written_out(n: Column, cells: Column, size: int = SIZES[0]) -> Column:
    """The fingerprint string: paragraphs, cells of a subtable, then place, count, digests and checks of each cell."""
    hexes = F.transform(cells, lambda e: F.concat_ws(".", F.lower(F.hex(e["i"])), e["c"].cast("string"), F.lower(F.hex(e["k"])), F.lower(F.hex(e["x"]))))
    return F.concat_ws(":", n.cast("string"), F.lit(str(size)), F.concat_ws(",", hexes))


def with_difference(df: DataFrame, name: str, a: str, b: str, a_cells: str, b_cells: str) -> DataFrame:
    """Adds ``name``: struct(cells, found) of the difference of the digest sets a and b, at the first size that peels
    whole. a_cells and b_cells are their sketches of the smallest size."""
    first = peeled(_merged(F.concat(F.col(a_cells), _negative(F.col(b_cells)))), SIZES[0])
    df = df.withColumn(name, first)
    for size in SIZES[1:]:
        again = peeled(_merged(F.concat(sketch(F.col(a), size), sketch(F.col(b), size, -1))), size)
        df = df.withColumn(name, F.when(F.size(F.col(name)["cells"]) == 0, F.col(name)).otherwise(again))
    return df


def likeness(difference: str, a: str, b: str) -> Column:
    """1 minus the share of the two texts' paragraphs that differ; 1 without paragraphs. Should even the largest
    sketch fail, the difference is taken from the digests themselves."""
    total = F.size(a) + F.size(b)
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    apart = F.when(F.size(F.col(difference)["cells"]) == 0, F.size(F.col(difference)["found"])).otherwise(exact)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - apart / total)


def with_next(texts: DataFrame, carry: list[str]) -> DataFrame:
    """Adds next_<c> for each column to rows (doc_id, text, ...): its value in the next row by doc_id, then text (nulls
    first); after the last row comes the first. Rows are dealt by ranges of doc_id, each range's last row takes the
    first row of the next range that has rows; there is one such row a range."""
    n = partitions(texts.sparkSession)
    cuts = texts.where("doc_id is not null").select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    steps = [1 << i for i in range(len(cuts).bit_length(), -1, -1)]
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")

    def further(p: Column, s: Column) -> Column:
        return F.when((p + s <= len(cuts)) & (F.try_element_at(bounds, p + s) <= F.col("doc_id")), p + s).otherwise(p)

    dealt = texts.withColumn("bucket", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    row = F.struct(*[F.col(c).alias(c) for c in carry])
    seen = dealt.withColumn("place", F.row_number().over(order)).withColumn("after", F.lead(row).over(order))
    firsts = seen.where("place = 1").select("bucket", row.alias("first"))
    along = Window.orderBy("bucket")  # a row a range: bounded by the number of partitions
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("following"))
    both = seen.join(firsts, "bucket", "left").withColumn("after", F.coalesce("after", "following"))
    return both.select(*texts.columns, *[F.col("after")[c].alias(f"next_{c}") for c in carry])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones (or all) of the next
    document by ascending doc_id. near_* are the likeness of the text's sketch to the edited and the next text's.
    Null texts are empty, and two texts without paragraphs are alike (1.0). Null ids come first, equal ids go by
    text; a single row is its own next; other columns are ignored; an empty table gives no rows. One shuffle moves the
    texts, by ranges of doc_id.
    """
    size = SIZES[0]
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("keys", digests(F.col("text")))
    rows = with_next(texts, ["text", "keys"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("tail", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - F.col("tail")), F.col("next_text").substr(F.lit(1), F.col("tail"))))
    rows = rows.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    for c in ("keys", "edited_keys", "next_keys"):
        rows = rows.withColumn(c.replace("keys", "cells"), sketch(F.col(c), size))
    rows = with_difference(rows, "to_edited", "keys", "edited_keys", "cells", "edited_cells")
    rows = with_difference(rows, "to_next", "keys", "next_keys", "cells", "next_cells")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written_out(F.size("keys"), F.col("cells")).alias("fingerprint"),
        written_out(F.size("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness("to_edited", "keys", "edited_keys").alias("near_edited"),
        likeness("to_next", "keys", "next_keys").alias("near_next"),
    )
