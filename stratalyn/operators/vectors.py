"""Operators over embeddings: centroids, representatives, neighbours, agreement of clusterings, graph groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centroids(df: DataFrame, keys: list[str], vector: str, unit: bool = True) -> DataFrame:
    """Mean vector of each group, normalised on request (aggregated by coordinate before the shuffle)."""
    each = df.select(*keys, F.posexplode(vector)).groupBy(*keys, "pos").agg(F.avg(F.col("col").cast("double")).alias("v"), F.count("*").alias("n"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"), F.max("n").alias("n"))
    return mean.withColumn("centroid", F.transform("centroid", lambda x: x / (norm(F.col("centroid")) + 1e-9))) if unit else mean


def ranked(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group, with ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Neighbours are sought in at least SPREAD * SPREAD tasks, where there are rows enough.
SPREAD = 8
#: Rows and columns of a tile of similarities, and the columns that share a maximum. A row with more than CROWD columns near its best is compared in full.
ROWS, COLUMNS, SHARED, CROWD = 256, 4096, 32, 1024


def foremost(r: np.ndarray, c: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places and values, the ``k`` best of each row, rounded to nine places, ties by column."""
    value = np.round(value, 9)
    order = np.lexsort((c, -value, r))
    r, c, value = r[order], c[order], value[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[kept], c[kept], value[kept]


def best(sim: np.ndarray, src: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``k`` best finite columns of each row, and their values rounded to nine places, ties by column.

    Names ascend; a column named like its row is none. Only values within rounding of a row's ``k``-th are sorted.
    """
    low, high = np.searchsorted(names, src, "left"), np.searchsorted(names, src, "right")
    for i in np.flatnonzero(high > low):
        sim[i, low[i] : high[i]] = -np.inf
    sim[np.isnan(sim)] = -np.inf
    least = np.partition(sim, -k, axis=1)[:, -k] - 2e-9 if sim.shape[1] > k else np.full(len(sim), -np.inf)
    r, c = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
    return foremost(r, c, sim[r, c], k)


def closest(q: np.ndarray, src: np.ndarray, t: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``best`` finds in ``q @ t.T``, rows of length one at most, with one product in single precision for all pairs.

    Only places within its error of a row's ``k``-th best are computed in double precision. Of equal columns, those with
    the least names are enough.
    """
    fine = np.flatnonzero(np.isfinite(t).all(axis=1))
    if len(fine) and t.shape[1]:
        same = np.unique(np.ascontiguousarray(t[fine]).view(f"V{8 * t.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order], "left")
        fine = np.sort(fine[order[nth < k + np.unique(names, return_counts=True)[1].max()]])
    t, names, rows = t[fine], names[fine], np.flatnonzero(np.isfinite(q).all(axis=1))
    q, src = q[rows], src[rows]
    low, high = np.searchsorted(names, src, "left"), np.searchsorted(names, src, "right")
    single, target, slack = q.astype(np.float32), t.astype(np.float32), np.float32((2 * t.shape[1] + 16) * 2.0**-24)
    found, crowded, room = [], [np.zeros(0, int)], np.empty(ROWS * min(COLUMNS, len(t)), np.float32)
    for at in range(0, len(q), ROWS):
        part, lo, hi = single[at : at + ROWS], low[at : at + ROWS], high[at : at + ROWS]
        floor, count, hits = np.full(len(part), -np.inf, np.float32), np.zeros(len(part), int), []
        for first in range(0, len(t), COLUMNS):
            some = target[first : first + COLUMNS]
            sim = np.matmul(part, some.T, out=room[: len(part) * len(some)].reshape(len(part), len(some)))
            for i in np.flatnonzero((hi > lo) & (hi > first) & (lo < first + sim.shape[1])):
                sim[i, max(0, lo[i] - first) : hi[i] - first] = -np.inf
            wide = sim.shape[1] // SHARED
            shared, rest = sim[:, : SHARED * wide].reshape(len(sim), SHARED, wide), sim[:, SHARED * wide :]
            top = np.concatenate([shared.max(axis=1), rest], axis=1)
            if top.shape[1] >= k:
                floor = np.maximum(floor, np.partition(top, -k, axis=1)[:, -k])
            r, g = np.divmod(np.flatnonzero(top >= floor[:, None] - slack), top.shape[1])
            one, many = g >= wide, g < wide
            each = shared[r[many], :, g[many]]
            i, j = np.divmod(np.flatnonzero(each >= floor[r[many], None] - slack), SHARED)
            c = np.concatenate([j * wide + g[many][i], g[one] + (SHARED - 1) * wide])
            value = np.concatenate([each[i, j], rest[r[one], g[one] - wide]])
            r = np.concatenate([r[many][i], r[one]])
            near = value > -np.inf
            hits.append((r[near], c[near] + first, value[near]))
            count += np.bincount(r[near], minlength=len(part))
            floor[count > CROWD] = np.inf
        r, c, value = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, int),) * 3
        near = value >= floor[r] - slack
        r, c = r[near] + at, c[near]
        found += [(r[i : i + 8192], c[i : i + 8192], np.einsum("ij,ij->i", q[r[i : i + 8192]], t[c[i : i + 8192]])) for i in range(0, len(r), 8192)]
        crowded.append(at + np.flatnonzero(count > CROWD))
    crowd = np.concatenate(crowded)
    step = max(1, (32 << 20) // (8 * max(1, len(t))))
    for at in range(0, len(crowd), step):
        i = crowd[at : at + step]
        r, c, value = best(q[i] @ t.T, src[i], names, k)
        found.append((i[r], c, value))
    r, c, value = foremost(*(np.concatenate(x) for x in zip(*found)), k) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return rows[r], fine[c], value


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows of length one."""
    whole = vectors.combine_chunks()
    width = pc.min_max(pc.list_value_length(whole)).as_py()
    if whole.null_count or width["min"] != width["max"]:
        raise ValueError("vectors must be of one width, none null")
    m = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), width["min"] or 0)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def nearest(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int, size_bound: int = 64 << 20) -> DataFrame:
    """Exact ``k`` nearest by cosine: (src, dst, rank, similarity), similarities rounded to nine places, ties by dst.

    Both sides are dealt into blocks of at most ``size_bound`` bytes of numbers, counted first. Every block of queries
    meets every block of the base in one task, as matrices; a task passes on its best ``k`` a query, never all pairs, and
    the answers are merged.
    """
    n, width = base.agg(F.count("*"), F.max(F.size(vector))).first()
    per = max(1, size_bound // (8 * max(1, width or 1)))
    blocks = max(1, -(-n // per), min(SPREAD, -(-n // 2048)))
    kind = base.schema[ident].dataType.simpleString()
    dealt = lambda d: d.select(ident, vector, F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int").alias("block"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt(queries).withColumn("other", spread).select("block", "other", F.lit(0).alias("side"), ident, vector)
    right = dealt(base).withColumnRenamed("block", "own").withColumn("block", spread).select("block", F.col("own").alias("other"), F.lit(1).alias("side"), ident, vector)

    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        at = [np.flatnonzero(side == i) for i in (0, 1)]
        (src, q), (dst, b) = [(x[ident].combine_chunks(), x[vector]) for x in (rows.take(i) for i in at)]
        none = pa.array([], pa.int64())
        if not len(src) or not len(dst):
            return pa.table({"src": src.take(none), "dst": dst.take(none), "similarity": pa.array([], pa.float64())})
        names = [x.to_pandas().to_numpy() for x in (src, dst)]
        i, j = (np.argsort(x, kind="stable") for x in names)
        r, c, value = closest(unit(q)[i], names[0][i], unit(b)[j], names[1][j], k)
        return pa.table({"src": src.take(pa.array(i[r])), "dst": dst.take(pa.array(j[c])), "similarity": value})

    found = left.unionByName(right).repartition(blocks * blocks, "block", "other").groupBy("block", "other").applyInArrow(run, f"src {kind}, dst {kind}, similarity double")
    return ranked(found, ["src"], "similarity", "dst", k)


def coassignment(df: DataFrame, first: str, second: str) -> DataFrame:
    """Share of the other points on whose togetherness two clusterings agree, by counts instead of pairs."""
    count = lambda *by: F.count("*").over(Window.partitionBy(*by))
    n = df.withColumn("_a", count(first)).withColumn("_b", count(second)).withColumn("_ab", count(first, second)).join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    return n.withColumn("agreement", F.try_divide(F.col("_n") - F.col("_a") - F.col("_b") + 2 * F.col("_ab") - 1, F.col("_n") - 1)).drop("_a", "_b", "_ab", "_n")


def persistence(df: DataFrame, base: str, runs: list[str]) -> DataFrame:
    """Mean over runs of the share of a point's cluster peers that stay with it."""
    count = lambda *by: F.count("*").over(Window.partitionBy(*by))
    d = df.withColumn("_a", count(base))
    share = lambda r: F.when(F.col("_a") <= 1, 1.0).otherwise((count(base, r) - 1) / (F.col("_a") - 1))
    return d.withColumn("stability", sum((share(r) for r in runs[1:]), share(runs[0])) / len(runs)).drop("_a")


def family_blocks(df: DataFrame, keys: list[str], family: str, least: int, out: str = "block") -> DataFrame:
    """``out``: families of at least ``least`` rows are blocks; the rest is ``pooled`` if it is as large or there is no block, else it joins the last block by name."""
    own = F.count("*").over(Window.partitionBy(*keys, family))
    whole = Window.partitionBy(*keys)
    d = df.withColumn("_n", own)
    small, last = F.count_if(F.col("_n") < least).over(whole), F.max(F.when(F.col("_n") >= least, F.col(family))).over(whole)
    return d.withColumn(out, F.when(F.col("_n") >= least, F.col(family)).when((small >= least) | last.isNull(), "pooled").otherwise(last)).drop("_n")


def ensemble_variants(runs: int, neighbours: int, distance: float, least: int, samples: int) -> list[dict]:
    """Settings of an ensemble of clusterings: each list is cycled at its own length, equal settings are left out."""
    cycles = {"neighbours": (10, 15, 25, neighbours), "distance": (0.0, 0.05, distance), "least": (5, 8, 12, least), "samples": (1, 3, 5, samples)}
    made = [{k: v[i % len(v)] for k, v in cycles.items()} for i in range(max(1, runs))]
    return [m for i, m in enumerate(made) if m not in made[:i]]


def summarise_clusters(df: DataFrame, keys: list[str], order: str, family: str, component: str | None = None, **means: str) -> DataFrame:
    """Size, means of non-null columns, the most frequent family (first seen on ties), and how many rows are components."""
    modal = df.groupBy(*keys, family).agg(F.count("*").alias("n"), F.min(order).alias("at")).groupBy(*keys).agg(F.max_by(family, F.struct("n", (-F.col("at")).alias("a"))).alias("family"))
    parts = [F.count_if(F.col(component)).alias("n_component_events"), F.count_if(~F.coalesce(F.col(component), F.lit(False))).alias("n_original_events")] if component else []
    return df.groupBy(*keys).agg(F.count("*").alias("size"), *parts, *[F.avg(c).alias(n) for n, c in means.items()]).join(modal, keys)


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a`` to ``b``, ascending, and the smallest node of each one's connected group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at.ravel(), 2)
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def propagate(edges: DataFrame, src: str = "src", dst: str = "dst", bound: int = 1 << 21) -> DataFrame:
    """Connected groups of an undirected graph: (node, label), label the smallest node.

    Up to ``bound`` edges, counted first, are solved in one task; more by minimum and pointer jumping over all machines.
    There every round is written to the shared folder and the one before deleted, so a lost executor costs a read, not a
    recomputation. The edges, or the last round, stay, as the result reads them.
    """
    from stratalyn.plans.session import delete, new_folder

    spark, folder = edges.sparkSession, new_folder(edges.sparkSession, "groups")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    pairs = kept(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).na.drop(), "pairs")
    if pairs.count() <= bound:
        kind = pairs.schema["a"].dataType.simpleString()

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := list(batches):
                rows = pa.Table.from_batches(got)
                found = groups(*(rows[c].to_pandas().to_numpy() for c in "ab"))
                yield from pa.table({n: pa.array(x, rows.schema.field("a").type) for n, x in zip(("node", "label"), found)}).to_batches(1 << 16)

        return pairs.coalesce(1).mapInArrow(solve, f"node {kind}, label {kind}")
    both = kept(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    delete(spark, f"{folder}/pairs")
    step, labels = 0, kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "0")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.least("label", "m").alias("label"))
        jump = kept(low.join(low.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.least("label", "up").alias("label")), str(step + 1))
        changed = jump.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        delete(spark, f"{folder}/{step}")
        step, labels = step + 1, jump
        if not changed:
            delete(spark, f"{folder}/edges")
            return labels
