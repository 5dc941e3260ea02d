"""SimHash near-duplicates found with vantage-point trees.

A fingerprint is 64 majority bits over XXH64 hashes of word shingles. Fingerprints link when they differ in at
most ``RADIUS`` bits; documents in one connected component of links are one group.

Search. A lone vantage-point tree over 64-bit Hamming space prunes about an eighth of the points per level at this
radius, so its work stays near quadratic. The forest below keeps the tree's two bounds and makes them bite:

* Root level: ``blocks`` disjoint bit blocks give sub-distances that sum to the Hamming distance. Two fingerprints
  within four bits are at sub-distance 0 on some choice of ``blocks - 4`` blocks, so one tree stands on each choice
  and a fingerprint descends only into the branch at sub-distance 0. The number of blocks follows the number of
  distinct fingerprints, so that a branch stays small at any input size.
* Shell level: within a branch, fingerprints are sharded by full Hamming distance to a vantage point. By the triangle
  inequality two linked fingerprints differ in that distance by at most four: a fingerprint is at home in one shell
  and queries the next shell down only if it lies within four of the boundary.
* Large shards (many near copies with distinct fingerprints) are split into pairs of blocks of bounded size, homes and
  queries alike.
* Leaf level: each shard is searched with a vantage-point tree in memory, exact at its leaves.

Each shard yields a spanning forest of its links, never all pairs; components are joined by alternating stars over
DataFrames, each round written to the shared folder. Fingerprints, hubs and components with very many rows are joined by
broadcast, at most 1,024 of them, and all others by shuffles. Only counts are collected to the driver.

Defined results: null and empty texts have fingerprint zero and link like others; very long texts are fingerprinted whole,
bytes that are not UTF-8 as they stand; repeated rows and ties are one group; null doc_ids keep their row and are ignored
as smallest doc_id; ``one_of_each`` passes all columns through, whatever their names, the others ignore them; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalyn.llm.common import cut, delete, join_counted, new_folder

RADIUS = 4
SHINGLE = 4
SEED = 42
SHELL = 9  # wider than twice the radius, so that a fingerprint overlaps one boundary at most
BRANCH = 512  # aimed at mean number of fingerprints of a branch
LEAF = 128
MAX_SHARD = 1 << 18  # fingerprints at home in one task; larger shards are split into pairs of blocks
CHUNK = 1 << 15


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text in UTF-8."""
    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    ends = ends[width - 1 :]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """``key`` columns and ``fp`` (the fingerprint as a signed long) of every document."""

    given = docs.select(*key, F.col("text").cast("binary").alias("raw"))
    schema = StructType([*given.schema.fields[:-1], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*key, "fp"])

    return given.mapInArrow(run, schema)


def plan_forest(n: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bit offsets of the blocks (with the end, 64) and the choices of blocks, for ``n`` distinct fingerprints."""
    blocks = RADIUS + 1
    while blocks < 12 and n >> (64 * (blocks - RADIUS) // blocks) > BRANCH:
        blocks += 1
    return [64 * i // blocks for i in range(blocks + 1)], list(combinations(range(blocks), blocks - RADIUS))


def _union(parent: np.ndarray, a: int, b: int) -> None:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a != b:
        parent[max(a, b)] = min(a, b)


def _leaf(fps: np.ndarray, home: np.ndarray, other: np.ndarray, parent: np.ndarray) -> None:
    """Join linked pairs among ``home`` and between ``home`` and ``other``, which start with ``home``."""
    near = np.bitwise_count(fps[home][:, None] ^ fps[other][None, :]) <= RADIUS
    if near.sum() <= len(home):
        return
    rows, cols, far = home.copy(), other.copy(), len(fps)
    while True:  # smallest index reachable within this leaf
        new_cols = np.minimum(cols, np.where(near, rows[:, None], far).min(axis=0))
        new_rows = np.where(near, new_cols[None, :], far).min(axis=1)
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    for i in np.flatnonzero(cols != other).tolist():
        _union(parent, int(other[i]), int(cols[i]))


def link_shard(fps: np.ndarray, n_home: int) -> np.ndarray:
    """Exact links of one shard by a vantage-point tree: the index of each fingerprint's root.

    The first ``n_home`` fingerprints are at home, the rest query the shard; pairs of two queries are another shard's.
    """
    parent = np.arange(len(fps))
    stack = [(np.arange(n_home), np.arange(n_home, len(fps)))]
    while stack:
        home, guest = stack.pop()
        if len(home) <= LEAF:
            if len(home):
                _leaf(fps, home, np.concatenate((home, guest)), parent)
            continue
        vantage = fps[home[0]]
        d, g = np.bitwise_count(fps[home] ^ vantage).astype(np.int64), np.bitwise_count(fps[guest] ^ vantage).astype(np.int64)
        radius = int(np.median(d))
        radius -= radius == d.max()
        inside = d <= radius
        if min(k := int(inside.sum()), len(home) - k) < len(home) // 32:  # no vantage point divides these
            for at in range(0, len(home), LEAF):
                _leaf(fps, home[at : at + LEAF], np.concatenate((home[at:], guest)), parent)
            continue
        stack.append((home[inside], np.concatenate((guest[g <= radius + RADIUS], home[~inside & (d <= radius + RADIUS)]))))
        stack.append((home[~inside], guest[g > radius - RADIUS]))
    for i in range(len(parent)):  # parents precede their children
        parent[i] = parent[parent[i]]
    return parent


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards arrive one after the other, home fingerprints first; yields (fp, root) of those with a link."""

    def edges(tree, branch, shell, pair, guest, fp):
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(branch) != 0) | (np.diff(shell) != 0) | (np.diff(pair) != 0)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            if hi - lo < 2 or guest[lo]:
                continue
            own = fp[lo:hi]
            root = link_shard(own.view(np.uint64), int(hi - lo - guest[lo:hi].sum()))
            if len(own := np.flatnonzero(root != np.arange(hi - lo))):
                a.append(fp[lo:hi][own])
                b.append(fp[lo:hi][root[own]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) if x else pa.array([], pa.int64()) for x in (a, b)], ["a", "b"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        if not len(cols[0]):
            continue
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        ends = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
        done = int(ends[-1]) + 1 if len(ends) else 0
        if done:
            yield edges(*(c[:done] for c in cols))
        kept = [c[done:] for c in cols]
    if kept is not None:
        yield edges(*kept)


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that join linked fingerprints; ``distinct`` has one row per fingerprint ``fp``, ``n`` rows."""
    offsets, choices = plan_forest(n)
    vantage = np.random.default_rng(SEED).integers(0, 1 << 63, len(choices)).tolist()

    def branch(choice: tuple[int, ...]):
        key, width = F.lit(0).cast("long"), 0
        for i in choice:
            bits = offsets[i + 1] - offsets[i]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", offsets[i]).bitwiseAND(F.lit((1 << bits) - 1)), width))
            width += bits
        return key

    trees = F.array(*[F.struct(F.lit(i).alias("tree"), branch(c).alias("branch"), F.bit_count(F.col("fp").bitwiseXOR(F.lit(v))).cast("int").alias("d")) for i, (c, v) in enumerate(zip(choices, vantage))])
    shell = lambda d: F.floor(d / F.lit(SHELL)).cast("int")
    at = distinct.select("fp", F.inline(trees))
    homes = at.select("tree", "branch", F.inline(F.array(F.struct(shell(F.col("d")).alias("shell"), F.lit(0).alias("guest")), F.struct(shell(F.col("d") - RADIUS).alias("shell"), F.lit(1).alias("guest")))), "d", "fp")
    sharded = homes.where((F.col("guest") == 0) | (F.col("shell") != shell(F.col("d")))).drop("d")
    shards = split_large(sharded)
    dealt = shards.repartition("tree", "branch", "shell", "pair").sortWithinPartitions("tree", "branch", "shell", "pair", "guest", "fp")
    return dealt.mapInArrow(_link_sorted, "a bigint, b bigint").distinct()


def split_large(sharded: DataFrame, most: int = 0) -> DataFrame:
    """Shards with more than ``MAX_SHARD`` homes or queries as pairs of blocks, so that no task holds more than two blocks.

    Homes and queries are dealt to blocks of their own by hash. A home of block s is at home in pairs (s, j) of home
    blocks with j >= s, queries the pairs (i, s) with i < s, and is at home in a pair with each block of queries; a
    query of block g queries its pair with every home block. All pairs of which one is at home still meet. ``pair``
    numbers the pairs of a shard; a small shard is one pair.
    """
    most, key = most or MAX_SHARD, ["tree", "branch", "shell"]
    blocks = lambda guest: F.greatest(F.ceil(F.count_if(F.col("guest") == guest) / most), F.lit(guest == 0).cast("long")).cast("int")
    large = sharded.groupBy(*key).agg(blocks(0).alias("k"), blocks(1).alias("m")).where("k > 1 OR m > 1")
    sized = sharded.join(large, key, "left")
    home = F.expr("transform(sequence(0, k - 1), j -> struct(least(own, j) * k + greatest(own, j) AS pair, IF(j < own, 1, 0) AS guest))")
    asked = F.expr("IF(m = 0, array(), transform(sequence(0, m - 1), g -> struct(k * k + own * m + g AS pair, 0 AS guest)))")
    asks = F.expr("transform(sequence(0, k - 1), i -> struct(k * k + i * m + own AS pair, 1 AS guest))")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("guest") == 0, F.col("k")).otherwise(F.col("m")).cast("long")).cast("int")
    alone = F.array(F.struct(F.lit(0).alias("pair"), F.col("guest")))
    return sized.withColumn("own", own).select(*key, "fp", F.inline(F.when(F.col("k").isNull(), alone).when(F.col("guest") == 0, F.concat(home, asked)).otherwise(asks))).select(*key, "pair", "guest", "fp")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars.

    Minima are aggregated before any shuffle; hubs are joined by broadcast (``join_counted``). Each round is written to
    the shared folder and the one before deleted.
    """
    spark, at, before = edges.sparkSession, new_folder(edges.sparkSession, "components"), None

    def kept(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{at}/{step}")
        if step:
            delete(spark, f"{at}/{step - 1}")
        return spark.read.schema("a bigint, b bigint").parquet(f"{at}/{step}")

    step, edges = 0, kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, step = now, step + 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0")
        large = join_counted(both.where("b > a"), least, ["a"], "n", now[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], "n", now[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = kept(small.where("a <> b").distinct(), step)


def near_duplicates(docs: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """``key`` columns, ``fp`` and ``component_id`` (smallest doc_id of the group) of every document; key holds doc_id."""
    each = cut(fingerprints(docs, key))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    size, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(distinct.select("fp"), size))
    # only linked fingerprints go through the second aggregation
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp").join(distinct.drop("n"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    named = join_counted(linked, least, ["root"], "m", size).select("fp", "component")
    known = cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n"))
    return join_counted(each, known, ["fp"], "n", total).select(*key, "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component, that with the smallest doc_id.

    Of equal doc_ids one row stays, that with the smallest hashes of its text and then of its whole row, and of a
    component without doc_ids one row. Only ids, hashes and fingerprints are grouped; texts are shuffled once, to meet
    their verdict. The row travels as one column, so no name can clash.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = near_duplicates(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), ["doc_id", "mark"])
    # within a component one (doc_id, mark) is chosen; its minimum is aggregated before the shuffle
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    best = found.groupBy("component_id", group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k")).select("k.doc_id", "k.mark").distinct()
    mine, theirs = rows.alias("d"), best.alias("b")
    both = mine.join(theirs, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.mark") == F.col("b.mark"))).select("d.*")
    first = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("all"))
    return both.withColumn("n", first).where("n = 1").select("row.*")
