"""Near-duplicate documents: MinHash signatures, banding, signature and exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import connected_components
from tidebook.llm.kernels import blocks, common, mix, shingle_sets
from tidebook.llm.runtime import id_text, partitions, returns_memory, settings, small_batches, written

BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS


def _family(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One universal hash for each minimum: the high 32 bits of a * x + b modulo 2**64, a odd."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)


#: The first family gives the buckets, each later one splits those that are still large and mixed.
FAMILIES = [_family(seed) for seed in (7, 8, 9)]
#: Share of equal minima that a pair needs before its full sets are compared: over 4 standard deviations under 0.75.
SIGNATURE_LEAST = 0.58
#: Partners of one pivot that are verified in one task; a pivot with more is dealt out by salt.
PER_PIVOT = 2000
#: A bucket's members outside its largest component: held at once, and so many that a bucket is split before.
BLOCK, MANY = 256, 4096
#: Members of a bucket that stream past a block in one task.
PER_SALT = 1024
#: Shingles that a comparison of two blocks holds at once.
COLUMNS = 16384


def signatures(sets: np.ndarray, off: np.ndarray, family: int = 0) -> np.ndarray:
    """Minima of every hash over each set (rows; empty sets give zeros), uint32."""
    a_, b_ = FAMILIES[family]
    out = np.zeros((len(off) - 1, N_HASHES), np.uint32)
    sizes = np.diff(off)
    rows = np.flatnonzero(sizes)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(off[rows], off[rows[a]] + 32768, "right")))
            lo, hi = off[rows[a]], off[rows[b - 1] + 1]
            x, at = sets[lo:hi], off[rows[a:b]] - lo
            y = np.empty_like(x)
            for p in range(N_HASHES):
                np.multiply(x, a_[p], out=y)
                y += b_[p]
                out[rows[a:b], p] = np.minimum.reduceat(y, at) >> np.uint64(32)
            a = b
    return out


@returns_memory
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in blocks(batch, "text"):
            sets, at = shingle_sets(buf, off)
            sig = signatures(sets, at)
            keys = [xxhash.xxh3_128_digest(sets[at[i] : at[i + 1]].tobytes()) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(at)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "signature"])


def _resigned(family: int):
    """doc_id and text to doc_id and the signature of another family."""

    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                sig = signatures(*shingle_sets(buf, off), family)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "signature"])

    return run


@returns_memory
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = np.broadcast_to(salt, sig.shape[:2]).copy()
            for r in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], ["bucket", "doc_id"])


@returns_memory
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, N_HASHES) for c in ("sig_u", "sig_v"))
        keep = (x == y).mean(axis=1) >= SIGNATURE_LEAST
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])


def _confirm(percent: int):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, []  # a pivot whose id has several texts has as many sets
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                sets, at = shingle_sets(buf, off)
                us, vs = [], []
                for i, (u, salt, side, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("u", "salt", "side", "doc")), strict=True)):
                    x = sets[at[i] : at[i + 1]]
                    if side == 0:
                        own = [*own, x.copy()] if pivot == (u, salt) else [x.copy()]
                        pivot = (u, salt)
                    elif pivot == (u, salt):
                        for y in own:
                            both = common(y, x)
                            if 100 * both >= percent * (len(y) + len(x) - both):
                                us.append(u)
                                vs.append(doc)
                                break
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def alike(pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """Those of the candidate pairs (u, v) whose signatures agree, once each."""
    sig = crowd.select(F.col("doc_id").alias("u"), F.col("signature").alias("sig_u"))
    pairs = pairs.join(sig, "u").join(sig.select(F.col("u").alias("v"), F.col("sig_u").alias("sig_v")), "v")
    return written(pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(_alike, "u long, v long").distinct(), "pairs")


def confirmed(pairs: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v), of a written table, whose full sets reach ``percent``.

    Every pair travels as one row with v's text to the place of its pivot u; a pivot with more than PER_PIVOT
    partners is dealt out by salt, so neither a pivot's partners nor its text are gathered or multiplied by them."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PER_PIVOT).cast("int").alias("salts"))
    partners = pairs.join(salts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), F.col("v").alias("doc"))
    pivots = salts.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("u").alias("doc"))
    rows = partners.union(pivots).join(crowd.select(F.col("doc_id").alias("doc"), "text"), "doc").select("u", "salt", "side", "doc", "text")
    spark = pairs.sparkSession
    dealt = rows.repartition(partitions(spark), "u", "salt").sortWithinPartitions("u", "salt", "side")
    return written(dealt.mapInArrow(_confirm(percent), "u long, v long"), "links")


@returns_memory
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components of which a held and a streamed member of one bucket have agreeing signatures: of all such
    pairs in a block those that join what the others don't."""
    least = int(np.ceil(SIGNATURE_LEAST * N_HASHES))
    key, parts, held, root = None, [], [], {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("bucket", "block", "salt", "side", "component")]
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, N_HASHES)
        us, vs = [], []
        for i, (bucket, block, salt, side, component) in enumerate(zip(*rows, strict=True)):
            if key != (bucket, block, salt):
                key, parts, held, root = (bucket, block, salt), [], [], {}
            if side == 0:
                parts.append(component)
                held.append(sig[i].copy())
                continue
            if isinstance(held, list):
                if not held:
                    continue
                held, parts = np.stack(held), np.array(parts)
            for other in np.unique(parts[(parts != component) & ((held == sig[i]).sum(axis=1) >= least)]).tolist():
                x, y = top(component), top(other)
                if x != y:
                    root[x] = y
                    us.append(component)
                    vs.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _join_blocks(docs: list[int], parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components: all pairs' exact intersections are one matrix product over
    the shingles that at least two of the sets hold; links that join nothing new are left out."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.append(start, len(every)))
    column = np.repeat(np.arange(len(start)), count)
    shared = np.repeat(count > 1, count)
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    width = int(column.max()) + 1 if len(column) else 0
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, width, COLUMNS):
        own = (column >= a) & (column < a + COLUMNS)
        held = np.zeros((len(sets), min(COLUMNS, width - a)), np.float32)
        held[owner[own], column[own] - a] = 1
        both += held @ held.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    home = np.array(parts)
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1) & (home[:, None] != home[None, :])), strict=True):
        if home[i] != home[j]:
            out.append((docs[i], docs[j]))
            home[home == home[j]] = home[i]
    return out


def _compare(percent: int):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, parts, sets = None, [], [], []
        links: list[tuple[int, int]] = []
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                found, at = shingle_sets(buf, off)
                for i, (g, one, two, doc, comp) in enumerate(zip(*(part.column(c).to_pylist() for c in ("area", "one", "two", "doc_id", "component")), strict=True)):
                    if key != (g, one, two):
                        links += _join_blocks(docs, parts, sets, percent) if docs else []
                        key, docs, parts, sets = (g, one, two), [], [], []
                    docs.append(doc)
                    parts.append(comp)
                    sets.append(found[at[i] : at[i + 1]].copy())
        links += _join_blocks(docs, parts, sets, percent) if docs else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, doc_id, component, home, total, minority) of the buckets (bucket, doc_id) that hold several components:
    the largest of them, all members, and those outside it."""
    placed = buckets.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = written(placed.select("bucket", "doc_id", "component"), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.sum("n").alias("total"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return placed.join(mixed.select("bucket", "home", "total", (F.col("total") - F.col("most")).alias("minority")), "bucket")


def _split(buckets: DataFrame, parts: DataFrame, crowd: DataFrame) -> DataFrame:
    """``_mixed`` rows of the buckets of several components. A bucket with over MANY members outside its largest
    component is split by the bands of the next family: two of its members meet again if they share a band there too.
    What the last family leaves large stays whole."""
    rows, out = _mixed(buckets, parts), None
    for family in range(1, len(FAMILIES)):
        rows = written(rows, "mixed")
        small, large = rows.where(F.col("minority") <= MANY), rows.where(F.col("minority") > MANY).select("bucket", "doc_id")
        out = small if out is None else out.unionByName(small)
        if large.isEmpty():
            return out
        again = large.select("doc_id").distinct().join(crowd.select("doc_id", "text"), "doc_id").mapInArrow(_resigned(family), "doc_id long, signature binary").mapInArrow(_bands, "bucket long, doc_id long").withColumnRenamed("bucket", "band")
        rows = _mixed(large.join(again, "doc_id").select(F.xxhash64("bucket", "band").alias("bucket"), "doc_id").distinct(), parts)
    return out.unionByName(written(rows, "mixed"))


def _look_alikes(buckets: DataFrame, parts: DataFrame, crowd: DataFrame) -> DataFrame:
    """Edges (u, v) between components that members of one bucket with agreeing signatures connect. Members outside a
    bucket's largest component are held in blocks of BLOCK, and all members stream past each block, dealt out by salt;
    a block gives at most a tree of its components."""
    spark = crowd.sparkSession
    now = _split(buckets, parts, crowd)
    n_blocks, n_salts = (F.ceil(F.col(c) / size).cast("int") for c, size in (("minority", BLOCK), ("total", PER_SALT)))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n).cast("int")
    held = now.where("component <> home").select("bucket", place(n_blocks, 1).alias("block"), each(n_salts).alias("salt"), F.lit(0).alias("side"), "doc_id", "component")
    past = now.select("bucket", each(n_blocks).alias("block"), place(n_salts, 2).alias("salt"), F.lit(1).alias("side"), "doc_id", "component")
    dealt = held.union(past).join(crowd.select("doc_id", "signature"), "doc_id").repartition(partitions(spark), "bucket", "block", "salt").sortWithinPartitions("bucket", "block", "salt", "side")
    return written(dealt.mapInArrow(_forest, "u long, v long").distinct(), "lookalikes")


def _late_links(alike_parts: DataFrame, parts: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components that look alike. An area is what ``alike_parts`` connects, so
    any two documents whose signatures agree lie in one area. Its documents are compared across components,
    blockwise, on their full sets: large components have blocks of their own, small ones share blocks, and two blocks
    meet only if they hold different components."""
    spark = crowd.sparkSession
    area = connected_components(alike_parts).select(F.col("node").alias("component"), F.col("component").alias("area"))
    docs = crowd.select("doc_id").distinct().join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = written(docs.join(area, "component").select("area", "doc_id", "component"), "areas")
    sizes = placed.groupBy("area", "component").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("area").agg(F.sum("size").alias("area_size"))
    placed = placed.join(sizes, ["area", "component"]).join(whole, "area")
    own = F.col("size") > BLOCK // 4
    placed = placed.select("area", "doc_id", "component", F.when(own, F.col("component")).alias("home"), F.when(own, F.ceil(F.col("size") / BLOCK)).otherwise(F.ceil(F.col("area_size") / BLOCK)).cast("int").alias("n"))
    placed = written(placed.select("area", "doc_id", "component", "home", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("n"))).alias("block")), "blocks")
    held = placed.select("area", "block", "home").distinct()
    x, y = held.alias("x"), held.alias("y")
    meet = x.join(y, F.col("x.area") == F.col("y.area")).where("x.block <= y.block and (x.home is null or y.home is null or x.home <> y.home)")
    meet = meet.select(F.col("x.area").alias("area"), F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    sides = meet.select("area", "one", "two", F.col("one").alias("block")).union(meet.where("one <> two").select("area", "one", "two", F.col("two").alias("block")))
    rows = placed.join(crowd.select("doc_id", "text"), "doc_id").join(sides, ["area", "block"])
    rows = rows.select("area", "one", "two", "doc_id", "component", "text").repartition(partitions(spark), "area", "one", "two").sortWithinPartitions("area", "one", "two", "doc_id")
    return written(rows.mapInArrow(_compare(percent), "u long, v long"), "late")


def _settled(links: DataFrame, buckets: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """(node, component) over ``links`` and over all links that the pivots missed."""
    parts = written(connected_components(links), "components")
    edges = _look_alikes(buckets, parts, crowd)
    if edges.isEmpty():
        return parts
    late = _late_links(edges, parts, crowd, percent)
    return parts if late.isEmpty() else written(connected_components(links.union(late)), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; with ``text_hash`` also Spark's xxhash64 of the
    text, which tells rows of one doc_id apart.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct five-word
    shingles; component_id is the smallest doc_id reachable over links and kept is doc_id = component_id.

    1. One pass over the texts gives each document its set size, a 128-bit key of the set and 128 universal-hash
       minima. Documents with equal sets form one class; only the smallest doc_id of a class goes on.
    2. 32 bands of 4 minima give buckets; a pair at 0.75 shares none with probability 5e-6. Each bucket pairs its
       members with a hashed pivot, another one in each band, so pairs grow with members, not with their square.
    3. Pairs pass a signature check, then the full sets, recomputed from the texts, decide.
    4. Components come from alternating large-star and small-star. Where a bucket still holds several components, its
       members are compared by signature; components that look alike by that form areas, in which documents of
       different components are compared blockwise on their full sets: no link is lost to the pivots.

    Defined cases: null or wordless texts have n_shingles 0 and link with nothing; a null doc_id gives component_id
    null and kept true; rows that repeat a doc_id each return the component of their own text's class, and classes
    whose smallest doc_id is the same are linked; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_text(docs, id_col, text_col)
    described = written(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary"), "minhash")
    # a class of any size is met salt by salt: no join holds more of it than a salt's share
    salted = described.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark))).cast("int"))
    usable = salted.where("doc_id is not null and n_shingles > 0")
    shares = written(usable.groupBy("set_key", "salt").agg(F.min("doc_id").alias("least")), "shares")
    classes = written(shares.join(shares.groupBy("set_key").agg(F.min("least").alias("rep")), "set_key"), "classes")
    heads = usable.join(classes.where("least = rep").select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    heads = written(heads.select("doc_id", "set_key", "signature").dropDuplicates(["doc_id", "set_key"]).select("doc_id", "signature"), "heads")
    bands = heads.mapInArrow(_bands, "bucket long, doc_id long")
    ends = bands.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi").select("bucket", "members")
    crowded = written(bands.join(ends, "bucket"), "buckets")
    # whoever shares no bucket needs neither signature nor text any more; the filter lets Spark's own runtime filter,
    # bounded in size, drop those rows before they are shuffled
    company = written(crowded.groupBy("doc_id").agg(F.max("members").alias("members")), "company").where("members > 1").select("doc_id")
    with settings(spark, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}):
        crowd = written(heads.join(company, "doc_id").join(texts.where("doc_id is not null"), "doc_id"), "crowd")

    pivots = crowded.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("bucket", "doc_id")).alias("u"))
    pairs = written(crowded.join(pivots, "bucket").select("u", F.col("doc_id").alias("v")).where("u <> v").distinct(), "stars")
    pairs = alike(pairs, crowd)
    parts = _settled(confirmed(pairs, crowd, percent), crowded.select("bucket", "doc_id"), crowd, percent)

    resolved = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", "salt", F.coalesce("component", "rep").alias("component"))
    out = salted.drop("signature").join(resolved, ["set_key", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *(["text_hash"] if text_hash else []))
