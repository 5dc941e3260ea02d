"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source is a queue of its documents in a shuffled order (md5 of a seed and the doc_id), up to ``EPOCHS`` times
over, served in proportion to its weight in quanta of at most ``QUANTUM`` words. A quantum's virtual finish time is the
number of words its source has queued up to its end, divided by the weight. All quanta, sorted by virtual finish time
over ranges of it, are served until the words served reach the budget, which is the size of the whole corpus; the
quantum in service then counts with the words that were left. So every source comes within one quantum of its target,
and sources that run dry leave their share to the others by weight. ``target`` states that share in closed form.

Running sums never sit in one task: a source is cut into ``4096`` slices of the shuffled order, a slice's sum is
aggregated first, and windows run over the sums of a source and the documents of a slice. The queue over all sources is
cut into ranges of virtual time in which about ``SPAN`` words finish: their sums, aggregated before the shuffle, say in
which range the budget ends, and only the quanta of that range are sorted one by one. One row per source and one per
range meet in one task. Texts are read once; sizes and keys are checkpointed.

Defined results: a null text has size 0 and is never taken; very long texts are many quanta; a null source is a source of
its own, ordered last; null doc_ids are shuffled by their text; quanta that finish at the same time are served in the
order of sources; repeated rows are queued once each; ``mix`` passes all columns through, whatever their names, ``report``
ignores the others; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
EPOCHS = 3
QUANTUM = 64
SPAN = 1 << 24
SEED = "mix-1:"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Not null, and in the order of code points with null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size) to (src, source_size, weight, target): water-filling at ``epochs`` times a source's size."""
    rank = F.row_number().over(Window.orderBy("src")) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    most = F.lit(epochs) * F.col("source_size")
    full = Window.orderBy(most / F.col("weight"), "src")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    dry = most / F.col("weight") <= (total - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(after)
    shared = weighed.withColumn("dry", dry).withColumn("total", total)
    time = (F.col("total") - F.sum(F.when(F.col("dry"), most).otherwise(0)).over(every)) / F.sum(F.when(F.col("dry"), 0.0).otherwise(F.col("weight"))).over(every)
    timed = shared.withColumn("time", F.when(F.sum(F.when(F.col("dry"), 0).otherwise(1)).over(every) > 0, time))
    return timed.select("src", "source_size", "weight", F.when(F.col("dry"), most.cast("double")).otherwise(F.col("weight") * F.col("time")).alias("target"))


def plan(docs: DataFrame, key: list[str] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, quantum: int = QUANTUM, span: int = SPAN) -> DataFrame:
    """``key`` columns, size, source_size, weight, target, virtual_finish (of the first pass) and served (words by pass)."""
    shuffled = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).cast("binary"))
    extra = [c for c in key if c != "doc_id"]
    each = cut(docs.select("doc_id", *extra, _key(F.col("source")).alias("src"), n_words(F.col("text")).alias("size"), shuffled.alias("at")).withColumn("slice", F.left("at", F.lit(3))))
    slices = each.groupBy("src", "slice").agg(F.sum("size").alias("sum"))
    goals = targets(slices.groupBy("src").agg(F.sum("sum").alias("source_size")), weights, epochs)
    ahead = F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slices.select("src", "slice", ahead.alias("ahead")).join(goals, "src")
    within = Window.partitionBy("src", "slice").orderBy("at", "doc_id", "size")
    queued = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queue = cut(each.withColumn("queued", queued).join(placed, ["src", "slice"]).withColumn("queued", F.col("queued") + F.col("ahead")).drop("slice", "ahead"))
    end = _budget_ends(queue, goals, epochs, quantum, span)
    finish, src, left = end or (float("-inf"), "", 0)
    earlier = lambda q: (q["finish"] < finish) | ((q["finish"] == finish) & (F.col("src") < src))
    words = lambda q: F.when(earlier(q), q["words"]).when((q["finish"] == finish) & (F.col("src") == src), left).otherwise(0).cast("long")
    served = F.array(*[F.aggregate(_quanta(F.lit(e), quantum), F.lit(0).cast("long"), lambda a, q: a + words(q)) for e in range(epochs)])
    return queue.select(*key, "size", "source_size", "weight", "target", ((F.col("queued") + F.col("size")) / F.col("weight")).alias("virtual_finish"), served.alias("served"))


def _quanta(e: Column, quantum: int) -> Column:
    """The quanta of a document in pass ``e``: words and virtual finish time."""
    end = lambda c: F.least(F.col("size"), (c + 1) * quantum)
    one = lambda c: F.struct(((F.col("queued") + e * F.col("source_size") + end(c)) / F.col("weight")).alias("finish"), (end(c) - c * quantum).alias("words"))
    return F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / quantum)), one)).otherwise(F.array().cast("array<struct<finish:double,words:bigint>>"))


def _budget_ends(queue: DataFrame, goals: DataFrame, epochs: int, quantum: int, span: int) -> tuple[float, str, int] | None:
    """Virtual finish time, source and words served of the quantum at which the words served reach the budget.

    Two rows reach the driver: the totals and the quantum.
    """
    budget, rate = goals.agg(F.sum("source_size"), F.sum("weight")).first()
    if not budget:
        return None
    quanta = queue.select("src", "size", "queued", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("e")).select("src", F.inline(_quanta(F.col("e"), quantum)))
    ranged = quanta.withColumn("part", F.floor(F.col("finish") * rate / span))
    upto = F.sum("sum").over(Window.orderBy("part"))
    part = ranged.groupBy("part").agg(F.sum("words").alias("sum")).select("part", "sum", upto.alias("upto")).where(F.col("upto") >= budget).orderBy("part").first()
    before = F.coalesce(F.sum("words").over(Window.partitionBy("part").orderBy("finish", "src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranged.where(F.col("part") == part["part"]).withColumn("left", F.lit(budget - part["upto"] + part["sum"]) - before)
    return tuple(inside.where("left > 0 AND left <= words").select("finish", "src", "left").first())


def report(docs: DataFrame) -> DataFrame:
    """The columns of op3, range-sorted by virtual finish time."""
    taken = F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x)
    return plan(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "virtual_finish").orderBy("virtual_finish", "doc_id")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself in the order of virtual finish times: rows of ``docs``, repeated as often as they are served.

    A document that the budget cuts keeps its first served words; ``n_chars``, where there, follows the text. The row
    travels as one column, so no name can clash.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = ["doc_id", "mark", "source"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", F.xxhash64(*columns).alias("all"), F.struct(*columns).alias("row"))
    plans = plan(docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", "text"), keys, weights, epochs)
    passes = F.filter(F.transform("served", lambda n, e: F.struct(n.alias("n"), e.alias("e"))), lambda x: x["n"] > 0)
    # equal rows of one doc_id are numbered, so that each meets its own plan
    same = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    left = rows.withColumn("i", same("all")).alias("d")
    right = plans.withColumn("i", same("virtual_finish")).where(F.size(passes) > 0).alias("p")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*keys, "i")]
    both = left.join(right, on).select("d.row", "d.doc_id", "p.size", "p.source_size", "p.weight", "p.virtual_finish", F.explode(passes).alias("pass"))
    part = F.regexp_substr(F.col("row.text"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("pass.n").cast("string"), F.lit("}+")))
    cuts = F.col("pass.n") < F.col("size")
    mixed = both.withColumn("row", F.when(cuts, F.col("row").withField("text", part)).otherwise(F.col("row")))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("row", F.when(cuts, F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType))).otherwise(F.col("row")))
    return mixed.orderBy(F.col("virtual_finish") + F.col("pass.e") * F.col("source_size") / F.col("weight"), "doc_id").select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS at
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
f AS (
  SELECT *, 3 * source_size / weight <= (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dry,
         sum(source_size) OVER () AS total
  FROM w),
t AS (
  SELECT src, source_size, weight, CASE WHEN dry THEN CAST(3 * source_size AS DOUBLE)
         ELSE weight * ((total - sum(CASE WHEN dry THEN 3 * source_size ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN dry THEN 0.0 ELSE weight END) OVER (), 0)) END AS target
  FROM f),
q AS (
  SELECT d.doc_id, d.src, d.size, t.source_size, t.weight, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.at, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queued
  FROM d JOIN t USING (src)),
m AS MATERIALIZED (SELECT *, row_number() OVER () AS row FROM q),
n AS (
  SELECT q.*, e, c, least(size, (c + 1) * 64) - c * 64 AS words, (queued + e * source_size + least(size, (c + 1) * 64)) / weight AS finish
  FROM m AS q, range(0, 3) AS p(e), LATERAL (SELECT unnest(range(0, (size + 63) // 64)) AS c)),
o AS (
  SELECT *, greatest(0, least(words, (SELECT sum(size) FROM q) - coalesce(sum(words) OVER (ORDER BY finish, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS served
  FROM n),
r AS (SELECT row, CAST(sum(served) AS BIGINT) AS taken FROM o GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, (queued + size) / weight AS virtual_finish
FROM m AS q LEFT JOIN r USING (row)
"""
