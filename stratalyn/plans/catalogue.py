"""Every relational operator as a query over the driver's tables, beside the SQL that must give the same rows.

Domain relations are mapped onto the tables: a recording is a user, its detections are that user's events (start = time
of the event, length = 1000 s per unit of value), ground truth is the purchases among them, a parent with components is
an order with its lines, windows and clusters are the embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalyn.functions import scores as sc
from stratalyn.operators import evaluation as ev
from stratalyn.operators import frames as fr
from stratalyn.operators import intervals as iv
from stratalyn.operators import routing as rt
from stratalyn.operators import tagging as tg
from stratalyn.operators import vectors as vx
from stratalyn.sources import service
from stratalyn.sources.recordings import with_split

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


# ---- relations ----------------------------------------------------------------------------------------------------

DET = """det AS (
  SELECT user_id AS rec, event_id, event_type, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 1000 * value AS e, value, 1000 * value AS len,
         value / 20 AS snr, (event_id % 97) / 97.0 AS flat, (event_id % 53) / 53.0 AS ton, (event_id % 31) / 31.0 AS bw, value / 25 AS peak,
         0.05 + (event_id % 400) / 50.0 AS dur, (event_id % 89) / 89.0 AS active, event_type = 'error' AS comp, user_id * 100 + event_id % 7 AS parent
  FROM events)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def detections(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        F.col("user_id").alias("rec"), "event_id", "event_type", s.alias("s"), (s + 1000 * F.col("value")).alias("e"), "value", (1000 * F.col("value")).alias("len"),
        (F.col("value") / 20).alias("snr"), (i % 97 / 97).alias("flat"), (i % 53 / 53).alias("ton"), (i % 31 / 31).alias("bw"), (F.col("value") / 25).alias("peak"),
        (0.05 + i % 400 / 50).alias("dur"), (i % 89 / 89).alias("active"), (F.col("event_type") == "error").alias("comp"), (F.col("user_id") * 100 + i % 7).alias("parent"),
    )


def rnd(c, n: int = 6):
    return F.round(c, n)


def _unit(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def _ramp(lo: float, hi: float, x: str) -> str:
    t = _unit(f"(({x}) - {lo}) / {hi - lo}::DOUBLE")
    return f"({t} * {t} * (3 - 2 * {t}))"


def _iou(a: str, b: str) -> str:
    return f"(CASE WHEN greatest({a}.e, {b}.e) - least({a}.s, {b}.s) > 0 THEN greatest(0.0::DOUBLE, least({a}.e, {b}.e) - greatest({a}.s, {b}.s)) / (greatest({a}.e, {b}.e) - least({a}.s, {b}.s)) ELSE 0 END)"


# ---- intervals ----------------------------------------------------------------------------------------------------


@query(f"""WITH {DET}, a AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM det),
b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT rec, round(min(s), 3) AS s, round(max(e), 3) AS e, count(*) AS n FROM b GROUP BY rec, g""")
def merge_intervals(spark, d):
    return iv.merge(detections(spark, d), ["rec"], "s", "e", 3600.0).select("rec", rnd("s", 3).alias("s"), rnd("e", 3).alias("e"), "n")


@query(f"""WITH {DET}, c AS (SELECT rec, event_id, s, e, unnest(range(0, CASE WHEN e - s > 100000 THEN CAST(ceil((e - s - 100000) / 50000) AS BIGINT) + 1 ELSE 1 END)) AS chunk FROM det),
x AS (SELECT rec, event_id, chunk, s + chunk * 50000 AS s, least(e, s + chunk * 50000 + 100000) AS e FROM c)
SELECT rec, event_id, CAST(chunk AS INT) AS chunk, round(s, 3) AS s, round(e, 3) AS e FROM x WHERE e - s >= 20000""")
def split_long(spark, d):
    out = iv.split_long(detections(spark, d).select("rec", "event_id", "s", "e"), "s", "e", 100000.0, 20000.0)
    return out.select("rec", "event_id", "chunk", rnd("s", 3).alias("s"), rnd("e", 3).alias("e"))


def _nms_sql(order: str, hit: str) -> str:
    return f"""WITH RECURSIVE {DET}, o AS (SELECT rec, event_id, parent, s, e, row_number() OVER (PARTITION BY rec ORDER BY {order}, event_id) AS rn FROM det),
r AS (SELECT rec, rn, [{{'i': event_id, 'p': parent, 's': s, 'e': e}}] AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.rec, o.rn, CASE WHEN len(list_filter(r.kept, lambda k: {_iou('k', 'o')} >= 0.3 {hit})) > 0 THEN r.kept ELSE list_append(r.kept, {{'i': o.event_id, 'p': o.parent, 's': o.s, 'e': o.e}}) END
  FROM r JOIN o ON o.rec = r.rec AND o.rn = r.rn + 1),
l AS (SELECT rec, max_by(kept, rn) AS kept FROM r GROUP BY rec)
SELECT rec, u.i AS event_id FROM (SELECT rec, unnest(kept) AS u FROM l)"""


@query(_nms_sql("value DESC", ""))
def temporal_nms(spark, d):
    return iv.suppress(detections(spark, d), ["rec"], "s", "e", "event_id", [-F.col("value")], 0.3).select("rec", "event_id")


@query(_nms_sql("value DESC", "AND k.p <> o.parent"))
def nms_same_parent(spark, d):
    return iv.suppress(detections(spark, d), ["rec"], "s", "e", "event_id", [-F.col("value")], 0.3, "parent").select("rec", "event_id")


LABEL = "CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 0 WHEN 'view' THEN 0 ELSE 1 END"


@query(f"""WITH RECURSIVE {DET}, w AS (SELECT rec, event_id, s, value, {LABEL} AS label, row_number() OVER (PARTITION BY rec ORDER BY s, event_id) AS rn FROM det),
r AS (SELECT rec, rn, label, s, s AS first, 1 AS run, event_id, value FROM w WHERE rn = 1
  UNION ALL
  SELECT w.rec, w.rn, w.label, w.s, CASE WHEN w.label = r.label AND w.s - (r.s + 3600) <= 43200 AND w.s + 3600 - r.first <= 172800 THEN r.first ELSE w.s END,
         CASE WHEN w.label = r.label AND w.s - (r.s + 3600) <= 43200 AND w.s + 3600 - r.first <= 172800 THEN r.run ELSE r.run + 1 END, w.event_id, w.value
  FROM r JOIN w ON w.rec = r.rec AND w.rn = r.rn + 1)
SELECT rec, label, round(min(s), 3) AS s, round(max(s) + 3600, 3) AS end_sec, count(*) AS n_windows, round(avg(value), 6) AS mean_value, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS windows
FROM r WHERE label >= 0 GROUP BY rec, label, run HAVING max(s) + 3600 - min(s) >= 7200""")
def runs_to_events(spark, d):
    w = detections(spark, d).withColumn("label", F.when(F.col("event_type") == "error", -1).when(F.col("event_type").isin("click", "view"), 0).otherwise(1))
    out = iv.runs(w, ["rec"], "s", "label", "event_id", 3600.0, 43200.0, 172800.0, 7200.0, ["value"])
    return out.select("rec", "label", rnd("s", 3).alias("s"), rnd("end_sec", 3).alias("end_sec"), "n_windows", rnd("mean_value").alias("mean_value"), F.array_join(F.col("windows").cast("array<string>"), ",").alias("windows"))


@query(f"""WITH {DET}, a AS (SELECT rec, event_id, s, value > 100 AS on_ FROM det),
b AS (SELECT *, CASE WHEN lag(on_) OVER (PARTITION BY rec ORDER BY s, event_id) IS DISTINCT FROM on_ THEN 1 ELSE 0 END AS c FROM a),
g AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
l AS (SELECT rec, on_, run, count(*) AS n FROM g GROUP BY rec, on_, run)
SELECT rec, coalesce(median(n) FILTER (WHERE on_), 0) AS median_active, coalesce(median(n) FILTER (WHERE NOT on_), 0) AS median_inactive, max(n) AS longest FROM l GROUP BY rec""")
def active_runs(spark, d):
    r = iv.activity_runs(detections(spark, d).withColumn("on_", F.col("value") > 100), ["rec"], ["s", "event_id"], "on_")
    side = lambda c: F.coalesce(F.median(F.when(c, F.col("length"))), F.lit(0.0))
    return r.groupBy("rec").agg(side(F.col("on_")).alias("median_active"), side(~F.col("on_")).alias("median_inactive"), F.max("length").alias("longest"))


COMPONENTS = """comp AS (
  SELECT l_orderkey AS parent, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS energy, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS ratio,
         1 - l_discount * 4 AS purity, l_quantity AS snr, l_tax * 5 AS compact, 0.02 + l_quantity / 100 AS dur, l_linenumber AS t0, l_linenumber + CAST(floor(l_quantity / 10) AS BIGINT) AS t1
  FROM lineitem)"""


def components(spark, d):
    share = F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("energy"), share.alias("ratio"), (1 - F.col("l_discount") * 4).alias("purity"), F.col("l_quantity").alias("snr"),
        (F.col("l_tax") * 5).alias("compact"), (0.02 + F.col("l_quantity") / 100).alias("dur"), F.col("l_linenumber").cast("long").alias("t0"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).alias("t1"),
    )


@query(f"""WITH {COMPONENTS}, f AS (SELECT parent, unnest(range(t0, t1 + 1)) AS t FROM comp), c AS (SELECT parent, t, count(*) AS n FROM f GROUP BY parent, t)
SELECT parent, round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS overlap_ratio FROM c GROUP BY parent""")
def overlap_ratio(spark, d):
    return iv.overlap_ratio(components(spark, d), ["parent"], "t0", "t1").select("parent", rnd("overlap_ratio").alias("overlap_ratio"))


# ---- frames -------------------------------------------------------------------------------------------------------

DB = "20 * log10(greatest(abs(value), 1e-10))"


@query(f"""WITH {DET}, a AS (SELECT rec, event_id, {DB} AS db, row_number() OVER (PARTITION BY rec ORDER BY s, event_id) AS i, count(*) OVER (PARTITION BY rec) AS n FROM det),
p AS (SELECT a.rec, a.event_id, b.db FROM a JOIN (SELECT unnest(range(-4, 5)) AS k) ON true JOIN a b ON b.rec = a.rec AND b.i = least(greatest(a.i + k, 1), a.n))
SELECT rec, event_id, round(list_sort(list(db))[2], 6) AS floor_db FROM p GROUP BY rec, event_id""")
def rolling_noise_floor(spark, d):
    f = detections(spark, d).withColumn("db", fr.decibel(F.col("value")))
    return fr.rolling_rank(f, ["rec"], ["s", "event_id"], "db", 9, 20, "floor_db").select("rec", "event_id", rnd("floor_db").alias("floor_db"))


@query(f"""WITH {DET}, a AS (SELECT rec, event_id, greatest(0.0::DOUBLE, coalesce(value - lag(value) OVER (PARTITION BY rec ORDER BY s, event_id), 0)) AS d FROM det),
m AS (SELECT *, median(d) OVER (PARTITION BY rec) AS m FROM a), q AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY rec) AS mad FROM m)
SELECT rec, event_id, round(least((d - m) / (1.4826 * mad + 1e-9), 1e6::DOUBLE), 4) AS z FROM q""")
def flux_zscore(spark, d):
    z = fr.robust_z(detections(spark, d), ["rec"], ["s", "event_id"], "value", "z")
    return z.select("rec", "event_id", rnd(F.least("z", F.lit(1e6)), 4).alias("z"))


@query(f"""WITH {DET}, n AS (SELECT *, quantile_cont({DB}, 0.2) OVER (PARTITION BY rec) AS fl, {DB} AS db, avg(value) OVER (PARTITION BY rec) AS m FROM det)
SELECT rec, event_id, (CAST(db > fl + 8 AS INT) + CAST(value > m AS INT) + CAST(flat < 0.40 AS INT)) >= 2 AS active FROM n""")
def vote_mask(spark, d):
    f = detections(spark, d).withColumn("db", fr.decibel(F.col("value")))
    level = f.groupBy("rec").agg(F.percentile("db", F.lit(0.2)).alias("fl"), fr.mean_in_order(F.col("value"), F.col("s"), F.col("event_id")).alias("m"))
    return f.join(level, "rec").select("rec", "event_id", fr.vote(2, F.col("db") > F.col("fl") + 8, F.col("value") > F.col("m"), F.col("flat") < 0.40).alias("active"))


def _morph(col: str, fn: str, before: int, after: int) -> str:
    w = f"OVER (PARTITION BY rec ORDER BY s, event_id ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"max({col}) {w}" if fn == "max" else f"CASE WHEN count(*) {w} = {before + after + 1} THEN min({col}) {w} ELSE 0 END"


@query(f"""WITH {DET}, a AS (SELECT rec, event_id, s, CAST(value > 60 AS INT) AS m FROM det),
b AS (SELECT rec, event_id, s, {_morph('m', 'min', 1, 1)} AS m FROM a), c AS (SELECT rec, event_id, s, {_morph('m', 'max', 1, 1)} AS m FROM b),
x AS (SELECT rec, event_id, s, {_morph('m', 'max', 2, 1)} AS m FROM c), y AS (SELECT rec, event_id, s, {_morph('m', 'min', 1, 2)} AS m FROM x)
SELECT rec, event_id, m = 1 AS mask FROM y""")
def morph_open_close(spark, d):
    f = detections(spark, d).withColumn("on_", F.col("value") > 60)
    return iv.morphology(f, ["rec"], ["s", "event_id"], "on_", 3, 4).select("rec", "event_id", "mask")


@query(f"""WITH {DET}, w AS (SELECT rec, event_id, s, e FROM det WHERE event_type = 'purchase')
SELECT w.rec, w.event_id, count(*) AS n_frames, round(avg(f.value), 6) AS mean_level, round(stddev_pop(f.value), 5) AS spread,
       round(0.45 * avg(f.snr) / 20 + 0.35 * avg(f.ton) + 0.20 * avg(f.active), 6) AS detection_score
FROM w JOIN det f ON f.rec = w.rec AND f.s BETWEEN w.s AND w.e GROUP BY w.rec, w.event_id""")
def frame_stats_per_event(spark, d):
    f = detections(spark, d)
    spans = f.where("event_type = 'purchase'").select("rec", "event_id", F.col("s").alias("ws"), F.col("e").alias("we"))
    frames = f.select("rec", "s", "value", "snr", "ton", "active")
    score = 0.45 * F.avg("snr") / 20 + 0.35 * F.avg("ton") + 0.20 * F.avg("active")
    return fr.mean_in_span(frames, spans, ["rec"], "s", "ws", "we", "event_id", 86400.0, F.count("*").alias("n_frames"), rnd(F.avg("value")).alias("mean_level"), rnd(F.stddev_pop("value"), 5).alias("spread"), rnd(score).alias("detection_score"))


PROFILE = f"""prof AS (SELECT rec, quantile_cont({DB}, 0.1) AS p10, quantile_cont({DB}, 0.5) AS p50, quantile_cont({DB}, 0.9) AS p90, median(ton) AS ton, median(flat) AS flat, avg(active) AS stat, count(*) / (max(s) - min(s) + 1) * 86400 AS density FROM det GROUP BY rec),
act AS (SELECT det.rec, count(*) FILTER (WHERE {DB} > p10 + 8) / count(*) AS active FROM det JOIN prof USING (rec) GROUP BY det.rec),
p AS (SELECT *, p90 - p10 AS dyn FROM prof JOIN act USING (rec))"""


def profile(spark, d):
    f = detections(spark, d).withColumn("db", fr.decibel(F.col("value")))
    span = F.max("s") - F.min("s") + 1
    p = f.groupBy("rec").agg(F.percentile("db", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.median("ton").alias("ton"), F.median("flat").alias("flat"), F.avg("active").alias("stat"), (F.count("*") / span * 86400).alias("density"))
    p = p.select("*", F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p90")).drop("q")
    act = f.join(p.select("rec", "p10"), "rec").groupBy("rec").agg((F.count_if(F.col("db") > F.col("p10") + 8) / F.count("*")).alias("active"))
    return p.join(act, "rec").withColumn("dyn", F.col("p90") - F.col("p10"))


@query(f"""WITH {DET}, {PROFILE}
SELECT rec, round(p10, 5) AS p10, round(p50, 5) AS p50, round(p90, 5) AS p90, round(active, 6) AS active,
       CASE WHEN density >= 1.5 AND stat >= 0.85 THEN 'sustained_narrowband' WHEN density >= 6 AND active < 0.40 THEN 'transient_dense' WHEN dyn < 18 THEN 'low_dynamic_range' WHEN active >= 0.20 AND stat < 0.70 THEN 'dense_variable' ELSE 'default_sparse' END AS regime FROM p""")
def recording_profile(spark, d):
    r = sc.regime(F.col("density"), F.col("stat"), F.col("density"), F.col("active"), F.col("dyn"))
    return profile(spark, d).select("rec", rnd("p10", 5).alias("p10"), rnd("p50", 5).alias("p50"), rnd("p90", 5).alias("p90"), rnd("active").alias("active"), r.alias("regime"))


REGIME = "CASE WHEN density >= 1.5 AND stat >= 0.85 THEN 'sustained_narrowband' WHEN density >= 6 AND active < 0.40 THEN 'transient_dense' WHEN dyn < 18 THEN 'low_dynamic_range' WHEN active >= 0.20 AND stat < 0.70 THEN 'dense_variable' ELSE 'default_sparse' END"


@query(f"""WITH {DET}, {PROFILE}, x AS (SELECT *, {REGIME} AS regime, CASE rec % 5 WHEN 0 THEN 'insect_sustained' WHEN 1 THEN 'marine_mammal' WHEN 2 THEN 'bird_calls' WHEN 3 THEN 'wind_dominant' ELSE 'amphibian' END AS hint FROM p)
SELECT rec, regime, hint, CASE WHEN hint = 'bird_calls' THEN 3.0 WHEN dyn < 12 THEN 4.0 WHEN dyn < 18 THEN 3.5 WHEN dyn < 25 THEN 5.0 ELSE 8.0 END::DOUBLE AS threshold_db,
       CASE hint WHEN 'marine_mammal' THEN 0.40 WHEN 'bird_calls' THEN 0.45 WHEN 'wind_dominant' THEN 0.65 ELSE CASE WHEN dyn < 12 THEN 0.25 WHEN dyn < 18 THEN 0.40 END END::DOUBLE AS min_quality,
       CASE WHEN hint IN ('insect_sustained', 'marine_mammal') THEN 0.05 WHEN ton < 0.10 THEN 0.05 WHEN ton < 0.20 THEN 0.10 END::DOUBLE AS tonality_floor,
       CASE hint WHEN 'insect_sustained' THEN 60.0 WHEN 'marine_mammal' THEN 2.0 WHEN 'bird_calls' THEN 3.0 ELSE CASE regime WHEN 'sustained_narrowband' THEN 30.0 WHEN 'transient_dense' THEN 2.0 WHEN 'dense_variable' THEN 8.0 END END::DOUBLE AS max_event,
       CASE hint WHEN 'insect_sustained' THEN 0.5 WHEN 'marine_mammal' THEN 0.05 WHEN 'bird_calls' THEN 0.10 ELSE CASE regime WHEN 'sustained_narrowband' THEN 0.5 WHEN 'transient_dense' THEN 0.08 WHEN 'dense_variable' THEN 0.25 END END::DOUBLE AS min_event,
       CASE WHEN hint = 'marine_mammal' THEN 0.08 ELSE CASE regime WHEN 'sustained_narrowband' THEN 0.6 WHEN 'transient_dense' THEN 0.1 WHEN 'dense_variable' THEN 0.4 END END::DOUBLE AS merge_gap,
       CASE WHEN hint = 'insect_sustained' OR regime IN ('sustained_narrowband', 'low_dynamic_range') THEN 1 END AS votes, CASE WHEN hint = 'insect_sustained' OR regime = 'sustained_narrowband' THEN false END AS flux,
       CASE WHEN dyn < 12 THEN 'exploratory' END AS noise_mode, CASE WHEN dyn < 12 THEN 0.10 END::DOUBLE AS min_eventness, CASE WHEN dyn < 12 THEN 82.0 END::DOUBLE AS flux_percentile, CASE WHEN dyn < 12 THEN 3.0 END::DOUBLE AS band_snr FROM x""")
def adaptive_params(spark, d):
    hints = F.create_map(*[F.lit(v) for pair in enumerate(("insect_sustained", "marine_mammal", "bird_calls", "wind_dominant", "amphibian")) for v in pair])
    p = profile(spark, d).withColumn("regime", sc.regime(F.col("density"), F.col("stat"), F.col("density"), F.col("active"), F.col("dyn"))).withColumn("hint", F.element_at(hints, (F.col("rec") % 5).cast("int")))
    return tg.adaptive(p, "dyn", "ton", "regime", "hint").select("rec", "regime", "hint", "threshold_db", "min_quality", "tonality_floor", "max_event", "min_event", "merge_gap", "votes", "flux", "noise_mode", "min_eventness", "flux_percentile", "band_snr")


@query(f"WITH {DET} SELECT rec, round(quantile_cont({DB}, 0.2), 6) AS noise_floor FROM det GROUP BY rec")
def noise_floor(spark, d):
    f = detections(spark, d).withColumn("db", fr.decibel(F.col("value")))
    return fr.noise_floor(f, ["rec"], "db").select("rec", rnd("noise_floor").alias("noise_floor"))


@query("""WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, round(coalesce(avg(list_dot_product(e, b) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(b, b)), 1e-12))), 1), 6) AS stationarity FROM v GROUP BY label""")
def stationarity(spark, d):
    return fr.stationarity(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding").select("label", rnd("stationarity").alias("stationarity"))


# ---- scores and routing -------------------------------------------------------------------------------------------

Q_SQL = f"(0.15 * {_ramp(3, 15, 'snr')} + 0.30 * (1 - {_ramp(0.35, 0.72, 'flat')}) + 0.20 * {_ramp(0.08, 0.42, 'ton')} + 0.05 * (1 - {_ramp(0.45, 0.95, 'bw')}) + 0.30 * {_ramp(3, 21, 'peak')})"
LOW_SQL = "(q < 0.55 OR (snr < 3 AND flat > 0.72 AND ton < 0.08) OR ton < 0.20)"
DUR_SQL = f"({_ramp(0.15, 0.5, 'dur')} * (1 - {_ramp(6, 8, 'dur')}))"
EV0 = f"(0.55 * {_ramp(4, 18, 'snr')} + 0.25 * (1 - {_ramp(0.55, 0.92, 'active')}) + 0.20 * {DUR_SQL})"
EV_SQL = _unit(f"(CASE WHEN comp THEN 0.75 * {EV0} + 0.25 * flat ELSE {EV0} END)")
WEAK_SQL = "(ev < CASE WHEN comp THEN 0.50 ELSE 0.28 END OR (active > 0.92 AND snr < 7))"
PREF_SQL = _unit(f"{_ramp(0.08, 0.25, 'dur')} * (1 - {_ramp(5, 8, 'dur')})")
SEL_SQL = f"(0.40 * ev + 0.25 * flat + 0.20 * q + 0.10 * {PREF_SQL} + 0.05 * {_unit('(value - 60 + 60) / 60')})"
STRUCT_SQL = _unit(f"0.45 * ton + 0.35 * (1 - flat) + 0.20 * {_ramp(0, 18, 'peak')}")
BROAD_SQL = _unit(f"0.50 * flat + 0.30 * {_unit('bw * 9000 / greatest(greatest(value * 10, 1.0) * 2, 1.0)')} + 0.20 * (1 - ton)")
OVER_SQL = "least(greatest(greatest(CASE WHEN comp THEN 0.4 ELSE 0 END, 0.5 * bw), 0.5 * (1 - flat)), 1)"
EDGE_SQL = "least((CASE WHEN dur < 0.20 THEN 0.45 ELSE 0 END) + (CASE WHEN dur > 7.2 THEN 0.35 ELSE 0 END) + (CASE WHEN active > 0.92 THEN 0.25 ELSE 0 END), 1)"
CLU_SQL = _unit(f"0.24 * ev + 0.22 * {_ramp(3, 21, 'greatest(snr, peak)')} + 0.20 * {STRUCT_SQL} + 0.14 * {DUR_SQL} + 0.14 * ton - 0.18 * {BROAD_SQL} - 0.08 * {OVER_SQL} - 0.06 * {EDGE_SQL} - CASE WHEN ton < 0.60 THEN 0.08 * (1 - ton) ELSE 0 END")
SCORED = f"""{DET}, sc0 AS (SELECT *, {Q_SQL} AS q, {EV_SQL} AS ev FROM det), scored AS (SELECT *, {SEL_SQL} AS sel, {CLU_SQL} AS clu FROM sc0)"""


def scored(spark, d):
    c = F.col
    x = detections(spark, d)
    duration = sc.duration_window(c("dur"), (0.15, 0.5), (6.0, 8.0))
    x = x.withColumn("q", sc.quality(c("snr"), c("flat"), c("ton"), c("bw"), c("peak"))).withColumn("ev", sc.eventness(c("snr"), c("active"), duration, c("comp"), c("flat")))
    clu = sc.clusterability(c("ev"), sc.smoothstep(3, 21, F.greatest(c("snr"), c("peak"))), sc.structure(c("ton"), c("flat"), c("peak")), duration, c("ton"), sc.broadband(c("flat"), c("bw") * 9000, c("value") * 10, c("ton")), sc.overlap_penalty(F.lit(False), c("comp"), c("bw"), c("flat")), sc.edge_penalty(c("dur"), c("active")))
    return x.withColumn("sel", sc.selection(c("ev"), c("flat"), c("q"), c("dur"), c("value") - 60, c("comp"))).withColumn("clu", clu)


def _low():
    return sc.low_confidence(F.col("q"), F.col("snr"), F.col("flat"), F.col("ton"))


def _weak():
    return (F.col("ev") < F.when(F.col("comp"), 0.50).otherwise(0.28)) | ((F.col("active") > 0.92) & (F.col("snr") < 7))


@query(f"WITH {SCORED} SELECT rec, event_id, round(q, 6) AS quality, {LOW_SQL} AS low FROM scored")
def quality_routing(spark, d):
    return scored(spark, d).select("rec", "event_id", rnd("q").alias("quality"), _low().alias("low"))


@query(f"WITH {SCORED} SELECT rec, event_id, round(ev, 6) AS eventness, {WEAK_SQL} AS weak FROM scored")
def eventness_routing(spark, d):
    return scored(spark, d).select("rec", "event_id", rnd("ev").alias("eventness"), _weak().alias("weak"))


@query(f"WITH {SCORED} SELECT rec, event_id, round(clu, 6) AS clusterability, CASE WHEN clu < 0.30 THEN 'low_confidence_noise' WHEN clu < 0.55 THEN 'ambiguous_review' ELSE 'original' END AS route FROM scored")
def clusterability_routing(spark, d):
    x = rt.finish(rt.route_clusterability(rt.start(scored(spark, d)), "clu"))
    return x.select("rec", "event_id", rnd("clu").alias("clusterability"), "route")


@query(f"WITH {DET} SELECT rec, event_id, CASE WHEN dur < 0.2 THEN 'short_review' ELSE 'original' END AS route, CASE WHEN dur < 0.2 THEN 'short_event:<0.200s' ELSE '' END AS reason FROM det")
def short_routing(spark, d):
    return rt.finish(rt.route_short(rt.start(detections(spark, d)), "dur")).select("rec", "event_id", "route", F.coalesce("route_reason", F.lit("")).alias("reason"))


@query(f"WITH {SCORED} SELECT rec, event_id, round(sel, 6) AS selection, round({STRUCT_SQL}, 6) AS structure, round({BROAD_SQL}, 6) AS broadband, round({OVER_SQL}, 6) AS overlap, round({EDGE_SQL}, 6) AS edge FROM scored")
def selection_scores(spark, d):
    c = F.col
    return scored(spark, d).select(
        "rec", "event_id", rnd("sel").alias("selection"), rnd(sc.structure(c("ton"), c("flat"), c("peak"))).alias("structure"), rnd(sc.broadband(c("flat"), c("bw") * 9000, c("value") * 10, c("ton"))).alias("broadband"),
        rnd(sc.overlap_penalty(F.lit(False), c("comp"), c("bw"), c("flat"))).alias("overlap"), rnd(sc.edge_penalty(c("dur"), c("active"))).alias("edge"),
    )


CQ_SQL = f"(0.30 * {_unit('purity')} + 0.25 * {_unit('snr / 16')} + 0.20 * {_unit('ratio / 0.24')} + 0.15 * {_unit('compact / 0.45')} + 0.10 * {_unit('dur / 0.24')})"
GATE_SQL = "CASE WHEN r >= 2 THEN 'component_rank_exceeds_clustering_limit' WHEN purity < 0.72 THEN 'component_purity_below_threshold' WHEN ratio < 0.12 THEN 'component_energy_ratio_below_threshold' WHEN snr < 8 THEN 'component_snr_below_threshold' WHEN compact < 0.15 THEN 'component_compactness_below_threshold' WHEN q < 0.62 THEN 'component_quality_below_threshold' ELSE 'clusterable_component' END"
GATED = f"{COMPONENTS}, gq AS (SELECT *, round({CQ_SQL}, 9) AS q FROM comp), gated AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY q DESC, l_linenumber, l_partkey, l_suppkey, energy) - 1 AS r FROM gq)"


def gated(spark, d):
    c = F.col
    x = components(spark, d).withColumn("q", rnd(sc.component_quality(c("purity"), c("snr"), c("ratio"), c("compact"), c("dur")), 9))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy(c("q").desc(), "l_linenumber", "l_partkey", "l_suppkey", "energy")) - 1)


@query(f"WITH {GATED}, g AS (SELECT {GATE_SQL} AS reason, q FROM gated) SELECT reason, count(*) AS n, round(avg(q), 5) AS mean_quality FROM g GROUP BY reason")
def component_gate(spark, d):
    c = F.col
    g = gated(spark, d).withColumn("reason", sc.component_gate(c("r"), c("purity"), c("ratio"), c("snr"), c("compact"), c("q")))
    return g.groupBy("reason").agg(F.count("*").alias("n"), rnd(F.avg("q"), 5).alias("mean_quality"))


@query(f"WITH {GATED} SELECT parent, l_linenumber, l_partkey, l_suppkey, CAST(r AS INT) AS rank, round(q, 6) AS quality FROM gated WHERE r < 3")
def parent_topk(spark, d):
    return gated(spark, d).where("r < 3").select("parent", "l_linenumber", "l_partkey", "l_suppkey", F.col("r").cast("int").alias("rank"), rnd("q").alias("quality"))


@query(f"""WITH {COMPONENTS}, f AS (SELECT parent, unnest(range(t0, t1 + 1)) AS t FROM comp), c AS (SELECT parent, t, count(*) AS n FROM f GROUP BY parent, t),
o AS (SELECT parent, count(*) FILTER (WHERE n > 1) / count(*) AS ov FROM c GROUP BY parent), a AS (SELECT parent, count(*) AS n, max(ratio) AS top, avg(purity) AS mean_purity FROM comp GROUP BY parent)
SELECT parent, n AS n_components, round(CASE WHEN n <= 1 THEN 0 ELSE {_unit('0.45 * least(1.0, (n - 1) / 3.0) + 0.35 * (1 - top) + 0.20 * ov')} END, 6) AS polyphony_score, round(mean_purity, 6) AS mean_purity,
       CASE WHEN n <= 1 OR top >= 0.88 THEN 'original' WHEN n > 4 THEN 'too_many_significant_components' WHEN ov > 0.45 THEN 'components_too_overlapping' ELSE 'split' END AS decision
FROM a JOIN o USING (parent)""")
def polyphony_score(spark, d):
    x = components(spark, d)
    a = x.groupBy("parent").agg(F.count("*").alias("n"), F.max("ratio").alias("top"), F.avg("purity").alias("mp")).join(iv.overlap_ratio(x, ["parent"], "t0", "t1"), "parent")
    decision = F.when((F.col("n") <= 1) | (F.col("top") >= 0.88), "original").when(F.col("n") > 4, "too_many_significant_components").when(F.col("overlap_ratio") > 0.45, "components_too_overlapping").otherwise("split")
    return a.select("parent", F.col("n").alias("n_components"), rnd(sc.polyphony(F.col("n"), F.col("top"), F.col("overlap_ratio"))).alias("polyphony_score"), rnd("mp").alias("mean_purity"), decision.alias("decision"))


def routed(spark, d) -> DataFrame:
    """The whole chain: row-wise routers, candidates among the survivors, row-wise routers."""
    x = rt.start(scored(spark, d).withColumn("det_score", F.when(F.col("event_type") != "signup", F.col("snr") / 24.5)))
    x = rt.route(x, F.col("det_score") < 0.05, rt.LOW_DETECTION, "low_detection")
    x = rt.route(x, _low(), rt.LOW_NOISE, "noise")
    x = rt.route(x, _weak(), rt.LOW_NOISE, "eventness")
    x = rt.route_candidates(x, ["rec"], "parent", "event_id", "s", "e", "sel", 3, 0.3)
    return rt.finish(rt.route_clusterability(rt.route_short(x, "dur"), "clu"))


ROUTED = f"""{SCORED}, r1 AS (SELECT *, CASE WHEN event_type <> 'signup' AND snr / 24.5 < 0.05 THEN 'low_detection_confidence' WHEN {LOW_SQL} THEN 'low_confidence_noise' WHEN {WEAK_SQL} THEN 'low_confidence_noise' END AS route FROM scored),
r2 AS (SELECT *, CASE WHEN route IS NULL AND row_number() OVER (PARTITION BY rec, parent, route IS NULL ORDER BY sel DESC, event_id) > 3 THEN 'low_confidence_noise' ELSE route END AS route2 FROM r1),
o AS (SELECT rec, event_id, parent, s, e, row_number() OVER (PARTITION BY rec ORDER BY sel DESC, event_id) AS rn FROM r2 WHERE route2 IS NULL),
rr AS (SELECT rec, rn, [{{'i': event_id, 'p': parent, 's': s, 'e': e}}] AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.rec, o.rn, CASE WHEN len(list_filter(rr.kept, lambda k: {_iou('k', 'o')} >= 0.3 AND k.p <> o.parent)) > 0 THEN rr.kept ELSE list_append(rr.kept, {{'i': o.event_id, 'p': o.parent, 's': o.s, 'e': o.e}}) END
  FROM rr JOIN o ON o.rec = rr.rec AND o.rn = rr.rn + 1),
kept AS (SELECT rec, unnest(k).i AS event_id FROM (SELECT rec, max_by(kept, rn) AS k FROM rr GROUP BY rec)),
routed AS (SELECT r2.*, coalesce(route2, CASE WHEN kept.event_id IS NULL THEN 'low_confidence_noise' WHEN dur < 0.2 THEN 'short_review' WHEN clu < 0.30 THEN 'low_confidence_noise' WHEN clu < 0.55 THEN 'ambiguous_review' ELSE 'original' END) AS final
  FROM r2 LEFT JOIN kept ON kept.rec = r2.rec AND kept.event_id = r2.event_id)"""


@query(f"""WITH RECURSIVE {ROUTED} SELECT rec, count(*) AS n_events, {', '.join(f"count(*) FILTER (WHERE final = '{b}') AS n_{b}" for b in ('original', 'component_review', 'low_detection_confidence', 'low_confidence_noise', 'ambiguous_review', 'short_review'))} FROM routed GROUP BY rec""")
def route_partition(spark, d):
    return rt.bucket_counts(routed(spark, d), ["rec"])


@query(f"WITH RECURSIVE {ROUTED} SELECT rec, event_id, final AS route, final = 'original' AS clusterable FROM routed")
def union_buckets(spark, d):
    return routed(spark, d).select("rec", "event_id", "route", "clusterable")  # buckets are a column: their union is the table


FAMILY = "CASE WHEN dur < 0.12 AND flat > 0.45 AND bw * 9000 > 1500 THEN 'broadband_click' WHEN value * 10 < 900 AND dur >= 0.18 AND ton >= 0.12 THEN 'low_frequency_call' WHEN dur >= 0.45 AND value * 10 >= 3000 AND ton >= 0.18 AND active * 10 >= 8 THEN 'insect_trill' WHEN flat >= 0.62 AND ton < 0.18 THEN 'noisy_burst' WHEN ton >= 0.48 AND bw * 9000 < greatest(900.0, 0.55 * value * 10) THEN 'tonal_whistle' WHEN ton >= 0.22 AND bw * 9000 < greatest(1800.0, 1.25 * value * 10) THEN 'harmonic_call' WHEN active * 10 >= 5 AND flat > 0.08 THEN 'pulse_train' ELSE 'unknown' END"


def families(spark, d):
    c = F.col
    return detections(spark, d).withColumn("family", sc.prefamily(c("dur"), c("flat"), c("bw") * 9000, c("value") * 10, c("ton"), c("active") * 10, c("flat")))


@query(f"WITH {DET} SELECT rec, event_id, {FAMILY} AS family FROM det")
def prefamily(spark, d):
    return families(spark, d).select("rec", "event_id", "family")


@query(f"""WITH {DET}, f AS (SELECT rec, event_id, {FAMILY} AS family FROM det), n AS (SELECT *, count(*) OVER (PARTITION BY rec, family) AS k FROM f),
b AS (SELECT rec, count(*) FILTER (WHERE k < 15) AS small, max(family) FILTER (WHERE k >= 15) AS last FROM n GROUP BY rec)
SELECT n.rec, CASE WHEN k >= 15 THEN family WHEN small >= 15 OR last IS NULL THEN 'pooled' ELSE last END AS block, count(*) AS n FROM n JOIN b ON b.rec = n.rec GROUP BY 1, 2""")
def prefamily_blocks(spark, d):
    return vx.family_blocks(families(spark, d), ["rec"], "family", 15).groupBy("rec", "block").agg(F.count("*").alias("n"))


# ---- evaluation ---------------------------------------------------------------------------------------------------

GT = "gt AS (SELECT rec, event_id AS gt_id, s, e FROM det WHERE event_type = 'purchase'), pr AS (SELECT rec, event_id AS pred_id, s, e FROM det WHERE event_type IN ('click', 'view'))"
COVER = "(CASE WHEN gt.e > gt.s THEN greatest(0.0::DOUBLE, least(pr.e, gt.e) - greatest(pr.s, gt.s)) / (gt.e - gt.s) ELSE 0 END)"
CAND = f"""cand AS (SELECT * FROM (SELECT gt.rec, gt_id, pred_id, gt.s AS gs, gt.e AS ge, pr.s AS ps, pr.e AS pe, {_iou('gt', 'pr')} AS iou, {COVER} AS cover FROM gt JOIN pr ON gt.rec = pr.rec AND gt.s <= pr.e AND pr.s <= gt.e) WHERE iou >= 0.3 OR cover >= 0.3)"""
MATCH = f"""{DET}, {GT}, {CAND}, mo AS (SELECT rec, gt_id AS g, pred_id AS p, greatest(iou, cover) AS score, iou, abs((gs + ge) / 2 - (ps + pe) / 2) AS err, row_number() OVER (PARTITION BY rec ORDER BY greatest(iou, cover) DESC, gt_id, pred_id) AS rn FROM cand),
mr AS (SELECT rec, rn, [{{'g': g, 'p': p, 'score': score, 'iou': iou, 'err': err}}] AS kept FROM mo WHERE rn = 1
  UNION ALL
  SELECT mo.rec, mo.rn, CASE WHEN len(list_filter(mr.kept, lambda k: k.g = mo.g OR k.p = mo.p)) > 0 THEN mr.kept ELSE list_append(mr.kept, {{'g': mo.g, 'p': mo.p, 'score': mo.score, 'iou': mo.iou, 'err': mo.err}}) END
  FROM mr JOIN mo ON mo.rec = mr.rec AND mo.rn = mr.rn + 1),
mat AS (SELECT rec, u.g AS gt_id, u.p AS pred_id, u.score AS score, u.iou AS iou, u.err AS err FROM (SELECT rec, unnest(k) AS u FROM (SELECT rec, max_by(kept, rn) AS k FROM mr GROUP BY rec)))"""
CNT = """cnt AS (SELECT rec, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM (SELECT rec, count(*) AS n_gt FROM gt GROUP BY rec) FULL JOIN (SELECT rec, count(*) AS n_pred FROM pr GROUP BY rec) USING (rec) LEFT JOIN (SELECT rec, count(*) AS tp FROM mat GROUP BY rec) USING (rec)),
met AS (SELECT rec, n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, coalesce(tp / nullif(n_pred, 0), 0) AS p, coalesce(tp / nullif(n_gt, 0), 0) AS r FROM cnt)"""


def truth(spark, d):
    x = detections(spark, d)
    gt = x.where("event_type = 'purchase'").select("rec", F.col("event_id").alias("gt_id"), F.col("s").alias("gs"), F.col("e").alias("ge"))
    pred = x.where(F.col("event_type").isin("click", "view")).select("rec", F.col("event_id").alias("pred_id"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    return gt, pred


def matched(spark, d):
    gt, pred = truth(spark, d)
    return gt, pred, ev.assign(ev.candidates(gt, pred, "rec", 0.3, 0.3), "rec")


@query(f"WITH {DET}, {GT}, {CAND} SELECT rec, gt_id, pred_id, round(iou, 6) AS iou, round(cover, 6) AS cover FROM cand")
def gt_candidates(spark, d):
    gt, pred = truth(spark, d)
    return ev.candidates(gt, pred, "rec", 0.3, 0.3).select("rec", "gt_id", "pred_id", rnd("iou").alias("iou"), rnd("cover").alias("cover"))


@query(f"WITH RECURSIVE {MATCH} SELECT rec, gt_id, pred_id, round(score, 6) AS score FROM mat")
def greedy_match(spark, d):
    return matched(spark, d)[2].select("rec", "gt_id", "pred_id", rnd("score").alias("score"))


@query(f"""WITH {DET}, {GT}, x AS (SELECT pr.rec, pred_id, gt_id, greatest({_iou('gt', 'pr')}, {COVER}) AS score FROM pr JOIN gt ON gt.rec = pr.rec AND gt.s <= pr.e AND pr.s <= gt.e),
b AS (SELECT *, row_number() OVER (PARTITION BY rec, pred_id ORDER BY score DESC, gt_id) AS k FROM x WHERE score > 0)
SELECT pr.rec, pr.pred_id, b.gt_id, round(b.score, 6) AS score FROM pr LEFT JOIN b ON b.rec = pr.rec AND b.pred_id = pr.pred_id AND b.k = 1""")
def best_gt(spark, d):
    gt, pred = truth(spark, d)
    return ev.best_truth(gt, pred, "rec").withColumn("score", rnd("score"))


FILES = "q AS (SELECT rec, avg(iou) AS mean_iou, median(err) AS median_error FROM mat GROUP BY rec), files AS (SELECT met.*, coalesce(mean_iou, 0) AS mean_iou, median_error FROM met LEFT JOIN q ON q.rec = met.rec)"


@query(f"WITH RECURSIVE {MATCH}, {CNT}, {FILES} SELECT rec, n_gt, n_pred, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(mean_iou, 6) AS mean_iou, round(median_error, 3) AS median_error FROM files")
def detection_metrics(spark, d):
    gt, pred = truth(spark, d)
    out = ev.detection(gt, pred, "rec")[0]
    return out.select("rec", "n_gt", "n_pred", "tp", "fp", "fn", *[rnd(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou")], rnd("median_error", 3).alias("median_error"))


@query(f"""WITH RECURSIVE {MATCH}, {CNT}, {FILES}, t AS (SELECT sum(n_gt) AS n_gt, sum(n_pred) AS n_pred, sum(tp) AS tp, sum(mean_iou * tp) / nullif(sum(tp), 0) AS mean_iou, median(median_error) AS median_error FROM files)
SELECT CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp, round(tp / n_pred, 6) AS precision, round(tp / n_gt, 6) AS recall, round(2 * tp / (n_pred + n_gt), 6) AS f1, round(coalesce(mean_iou, 0), 6) AS mean_iou, round(median_error, 3) AS median_error FROM t""")
def rollup_metrics(spark, d):
    gt, pred = truth(spark, d)
    t = ev.roll_up(ev.detection(gt, pred, "rec")[0])
    return t.select("n_gt", "n_pred", "tp", *[rnd(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou")], rnd("median_error", 3).alias("median_error"))


@query(f"""WITH {DET}, p AS (SELECT rec, event_id, CASE WHEN comp THEN CAST(parent AS VARCHAR) END AS parent_id, s, e, snr, event_type, CASE WHEN comp THEN 'component' ELSE 'original' END AS source_type FROM det),
c AS (SELECT rec, parent_id, min(s) AS s, max(e) AS e, max(snr) AS snr, count(*) AS n, min(event_id) AS first FROM p WHERE parent_id IS NOT NULL GROUP BY rec, parent_id)
SELECT rec, CAST(event_id AS VARCHAR) AS prediction_id, event_id, event_type, round(s, 3) AS start_sec, round(e, 3) AS end_sec, round(snr, 6) AS detection_score, 1 AS n_members, source_type FROM p WHERE parent_id IS NULL
UNION ALL SELECT c.rec, c.parent_id, c.first, p.event_type, round(c.s, 3), round(c.e, 3), round(c.snr, 6), n, CASE WHEN n > 1 THEN 'parent_aggregated' ELSE p.source_type END FROM c JOIN p ON p.rec = c.rec AND p.event_id = c.first""")
def parent_collapse(spark, d):
    x = detections(spark, d).select("rec", "event_id", "event_type", F.when(F.col("comp"), F.col("parent").cast("string")).alias("parent_event_id"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec"), F.col("snr").alias("detection_score"), F.when(F.col("comp"), "component").otherwise("original").alias("source_type"))
    out = ev.collapse_parents(x, "rec")
    return out.select("rec", "prediction_id", "event_id", "event_type", rnd("start_sec", 3).alias("start_sec"), rnd("end_sec", 3).alias("end_sec"), rnd("detection_score").alias("detection_score"), "n_members", "source_type")


@query(f"""WITH {DET}, m AS (SELECT rec, CASE WHEN comp THEN 'component' WHEN bw > 0.9 THEN 'mixed' ELSE 'original' END AS source, comp, CASE WHEN event_type <> 'signup' THEN flat END AS purity FROM det)
SELECT rec, count(*) AS n_events, count(*) FILTER (WHERE source = 'mixed') AS n_mixed, count(*) FILTER (WHERE comp) AS n_components, count(*) FILTER (WHERE source = 'original') AS n_original, round(avg(purity), 6) AS mean_purity, true AS enabled,
       round(count(*) FILTER (WHERE source = 'mixed') / count(*), 6) AS mixed_rate, round(count(*) FILTER (WHERE comp) / count(*), 6) AS component_rate FROM m GROUP BY rec""")
def polyphony_metrics(spark, d):
    x = detections(spark, d)
    source = F.when(F.col("comp"), "component").when(F.col("bw") > 0.9, "mixed").otherwise("original")
    e = x.select("rec", source.alias("source_type"), (F.col("bw") > 0.9).alias("is_mixed"), F.col("comp").alias("is_component"), F.col("parent").alias("parent_event_id"), F.when(F.col("event_type") != "signup", F.col("flat")).alias("purity_score"), F.col("bw").alias("polyphony_score"))
    out = ev.polyphony(e, ["rec"])
    return out.select("rec", "n_events", "n_mixed", "n_components", "n_original", "enabled", *[rnd(c).alias(c) for c in ("mean_purity", "mixed_rate", "component_rate")])


@query(f"WITH RECURSIVE {MATCH} SELECT rec, gt_id AS id, 'missed' AS kind FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM mat) UNION ALL SELECT rec, pred_id, 'spurious' FROM pr WHERE pred_id NOT IN (SELECT pred_id FROM mat)")
def unmatched(spark, d):
    gt, pred, m = matched(spark, d)
    missed = gt.join(m, ["rec", "gt_id"], "left_anti").select("rec", F.col("gt_id").alias("id"), F.lit("missed").alias("kind"))
    return missed.unionByName(pred.join(m, ["rec", "pred_id"], "left_anti").select("rec", F.col("pred_id").alias("id"), F.lit("spurious").alias("kind")))


@query(f"""WITH {SCORED}, f AS (SELECT *, {FAMILY} AS family FROM scored), n AS (SELECT event_type, family, count(*) AS n, min(event_id) AS first_id FROM f GROUP BY event_type, family), m AS (SELECT event_type, family, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first_id) AS k FROM n)
SELECT f.event_type, count(*) AS size, round(avg(q), 5) AS mean_quality, round(avg(clu), 5) AS mean_clusterability, min(m.family) AS family FROM f JOIN m ON m.event_type = f.event_type AND k = 1 GROUP BY f.event_type""")
def cluster_summary(spark, d):
    x = scored(spark, d).join(families(spark, d).select("event_id", "family"), "event_id")
    out = vx.summarise_clusters(x, ["event_type"], "event_id", "family", mean_quality="q", mean_clusterability="clu")
    return out.select("event_type", "size", rnd("mean_quality", 5).alias("mean_quality"), rnd("mean_clusterability", 5).alias("mean_clusterability"), "family")


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), c AS (SELECT source, sum(n) AS size, max(n) AS top FROM n GROUP BY source)
SELECT count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_events, round(avg(top / size), 6) AS mean_purity, round(sum(top) / sum(size), 6) AS weighted_purity, round(sum(size) / count(*), 6) AS compression, round(avg(size), 6) AS mean_size, median(size) AS median_size FROM c""")
def purity_compression(spark, d):
    out = ev.purity(table(spark, d, "documents"), [], "lang", "source")
    return out.select("n_clusters", "n_events", "median_size", *[rnd(c).alias(c) for c in ("mean_purity", "weighted_purity", "compression", "mean_size")])


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), a AS (SELECT lang, sum(n) AS a FROM n GROUP BY lang), b AS (SELECT source, sum(n) AS b FROM n GROUP BY source), t AS (SELECT sum(n) AS t FROM n),
mi AS (SELECT sum(n / t * ln((n / t) / ((a / t) * (b / t)))) AS mi, sum(n * (n - 1) / 2) AS nn FROM n JOIN a USING (lang) JOIN b USING (source), t), ha AS (SELECT sum(-a / t * ln(a / t)) AS ha, sum(a * (a - 1) / 2) AS aa FROM a, t), hb AS (SELECT sum(-b / t * ln(b / t)) AS hb, sum(b * (b - 1) / 2) AS bb FROM b, t)
SELECT round(2 * mi / (ha + hb), 6) AS nmi, round((nn - aa * bb / (t * (t - 1) / 2)) / ((aa + bb) / 2 - aa * bb / (t * (t - 1) / 2)), 6) AS ari FROM mi, ha, hb, t""")
def nmi_ari(spark, d):
    return ev.agreement(table(spark, d, "documents"), "lang", "source").select(rnd("nmi").alias("nmi"), rnd("ari").alias("ari"))


@query(f"""WITH RECURSIVE {MATCH}, k AS (SELECT pr.rec, pr.pred_id, pr.pred_id IN (SELECT pred_id FROM mat) AS hit, row_number() OVER (PARTITION BY pr.rec ORDER BY pr.e - pr.s DESC, pr.pred_id) AS rn FROM pr)
SELECT round(avg(CAST(hit AS INT)), 6) AS normal_precision, round(avg(CAST(hit AS INT)) FILTER (WHERE rn <= 5), 6) AS precision_at_5, (SELECT round(count(DISTINCT gt_id) / (SELECT count(*) FROM gt), 6) FROM mat) AS recall_any FROM k""")
def assistant_metrics(spark, d):
    gt, pred, m = matched(spark, d)
    hit = pred.join(m.select("rec", "pred_id", F.lit(1).alias("hit")), ["rec", "pred_id"], "left").na.fill(0, ["hit"])
    w = Window.partitionBy("rec").orderBy((F.col("pe") - F.col("ps")).desc(), "pred_id")
    top = hit.withColumn("rn", F.row_number().over(w)).agg(rnd(F.avg("hit")).alias("normal_precision"), rnd(F.avg(F.when(F.col("rn") <= 5, F.col("hit")))).alias("precision_at_5"))
    found = m.agg(F.count_distinct("gt_id").alias("f")).crossJoin(F.broadcast(gt.agg(F.count("*").alias("n")))).select(rnd(F.col("f") / F.col("n")).alias("recall_any"))
    return top.crossJoin(F.broadcast(found))


@query(f"WITH {DET} SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM det GROUP BY event_type")
def numeric_summary(spark, d):
    return ev.summary(detections(spark, d), ["event_type"], "value").select("event_type", "n", rnd("mean", 5).alias("mean"), *[rnd(c).alias(c) for c in ("median", "p10", "p90")])


AUDIT = ["n_chars", "n_words", "share"]
DOCS = "docs AS (SELECT d.doc_id, l.quality = 1 AS good, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words, CASE WHEN d.doc_id % 3 > 0 THEN len(string_split(text, ' ')) / n_chars END AS share FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, d):
    n = F.size(F.split("text", " "))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), F.col("n_chars").cast("double").alias("n_chars"), n.cast("double").alias("n_words"), F.when(F.col("doc_id") % 3 > 0, n / F.col("n_chars")).alias("share"))


@query(f"""WITH {DOCS}, u AS ({' UNION ALL '.join(f"SELECT good, '{f}' AS feature, {f} AS v FROM docs" for f in AUDIT)}),
a AS (SELECT feature, count(v) FILTER (WHERE good) AS n1, count(v) FILTER (WHERE NOT good) AS n0, avg(v) FILTER (WHERE good) AS m1, avg(v) FILTER (WHERE NOT good) AS m0, median(v) FILTER (WHERE good) AS q1, median(v) FILTER (WHERE NOT good) AS q0, stddev_samp(v) FILTER (WHERE good) AS s1, stddev_samp(v) FILTER (WHERE NOT good) AS s0 FROM u WHERE v IS NOT NULL GROUP BY feature)
SELECT feature, n1 AS n_matched, n0 AS n_unmatched, round(m1, 4) AS mean_matched, round(m0, 4) AS mean_unmatched, round(q1, 5) AS median_matched, round(q0, 5) AS median_unmatched, round(abs(m1 - m0) / ((s1 + s0) / 2), 5) AS separation, round((m1 + m0) / 2, 4) AS threshold, CASE WHEN m1 >= m0 THEN 'higher' ELSE 'lower' END AS direction FROM a""")
def fp_audit(spark, d):
    out = ev.audit(labelled(spark, d), "good", AUDIT)
    r = lambda c, n: rnd(c, n).alias(c)
    return out.select("feature", "n_matched", "n_unmatched", r("mean_matched", 4), r("mean_unmatched", 4), r("median_matched", 5), r("median_unmatched", 5), r("separation", 5), r("threshold", 4), "direction")


GRID = (("least_chars", "n_chars", (500.0, 1000.0, 2000.0), "min"), ("most_chars", "n_chars", (500.0, 2000.0, 8000.0), "max"), ("least_words", "n_words", (50.0, 100.0, 400.0), "min"), ("least_share", "share", (0.1, 0.15, 0.2), "min"), ("most_share", "share", (0.14, 0.16, 0.2), "max"))
SWEPT = f"""{DOCS}, u AS ({' UNION ALL '.join(f"SELECT good, '{name}' AS name, '{way}' AS direction, {t}::DOUBLE AS threshold, {f} IS NULL OR {f} {'>=' if way == 'min' else '<='} {t} AS kept FROM docs" for name, f, ts, way in GRID for t in ts)}),
a AS (SELECT name, direction, threshold, count(*) AS n, count(*) FILTER (WHERE good) AS m, count(*) FILTER (WHERE kept) AS k, count(*) FILTER (WHERE kept AND good) AS km FROM u GROUP BY name, direction, threshold),
b AS (SELECT *, coalesce(km / nullif(k, 0), 0) AS p, km / m AS rk, coalesce(km / nullif(k, 0), 0) - m / n AS g FROM a)"""


@query(f"WITH {SWEPT} SELECT name, direction, threshold, k AS n_kept, round(p, 6) AS precision, round(g, 6) AS gain, round(rk, 6) AS recall_kept FROM b")
def calibration_sweep(spark, d):
    s = ev.sweep(labelled(spark, d), "good", GRID)
    return s.select("name", "direction", "threshold", "n_kept", rnd("precision").alias("precision"), rnd("gain").alias("gain"), rnd("recall_kept").alias("recall_kept"))


@query(f"WITH {SWEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(g, 12) DESC, round(p, 12) DESC, threshold) AS i FROM b WHERE rk >= 0.85) SELECT name, threshold AS value, round(g, 6) AS gain, round(p, 6) AS precision FROM r WHERE i = 1")
def recommended_thresholds(spark, d):
    return ev.recommended(ev.sweep(labelled(spark, d), "good", GRID)).select("name", "value", rnd("gain").alias("gain"), rnd("precision").alias("precision"))


@query("""WITH t AS (SELECT o_orderpriority AS trial, round(avg(o_totalprice), 0) AS score, count(*) AS f1, count(DISTINCT o_custkey) AS weighted_purity FROM orders GROUP BY 1) SELECT trial FROM t ORDER BY score DESC, f1 DESC, weighted_purity DESC, trial LIMIT 1""")
def best_trial(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("trial")).agg(F.round(F.avg("o_totalprice"), 0).alias("score"), F.count("*").alias("f1"), F.count_distinct("o_custkey").alias("weighted_purity"))
    return ev.best_trial(t).select("trial")


@query(f"""WITH {SCORED}, c AS (SELECT * FROM (VALUES ('off', 0.0::DOUBLE), ('exploratory', 0.43::DOUBLE), ('balanced', 0.55::DOUBLE), ('conservative', 0.70::DOUBLE)) AS v(mode, t)),
x AS (SELECT mode, t, CASE WHEN mode = 'off' THEN true ELSE NOT (q < t OR (snr < 3 AND flat > 0.72 AND ton < 0.08) OR ton < 0.20) END AS kept, event_type = 'purchase' AS hit FROM scored, c)
SELECT mode, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE kept AND hit) AS n_hits, round(count(*) FILTER (WHERE kept AND hit) / count(*) FILTER (WHERE kept), 6) AS precision FROM x GROUP BY mode""")
def config_sweep(spark, d):
    x = scored(spark, d)
    modes = F.array(F.struct(F.lit("off").alias("mode"), F.lit(True).alias("kept")), *[F.struct(F.lit(m).alias("mode"), (~sc.low_confidence(F.col("q"), F.col("snr"), F.col("flat"), F.col("ton"), m)).alias("kept")) for m in sc.MODES])
    each = x.select(F.explode(modes).alias("m"), (F.col("event_type") == "purchase").alias("hit")).select("m.mode", "m.kept", "hit")
    out = each.groupBy("mode").agg(F.count_if("kept").alias("n_kept"), F.count_if(F.col("kept") & F.col("hit")).alias("n_hits"))
    return out.withColumn("precision", rnd(ev.rate(F.col("n_hits"), F.col("n_kept"))))


@query(f"""WITH RECURSIVE {MATCH}, {CNT}, t AS (SELECT 2 * sum(tp) / (sum(n_pred) + sum(n_gt)) AS f1 FROM met), i AS (SELECT avg(score) AS mi FROM mat),
n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), c AS (SELECT source, sum(n) AS size, max(n) AS top FROM n GROUP BY source), p AS (SELECT sum(top) / sum(size) AS pu, sum(size) / count(*) AS co FROM c)
SELECT round(100 * (0.40 * f1 + 0.25 * pu + 0.15 * least(1.0, ln(1 + co) / ln(21)) + 0.10 * mi + 0.10 * 0.5), 5) AS score FROM t, i, p""")
def global_score(spark, d):
    gt, pred, m = matched(spark, d)
    t = ev.with_rates(ev.detection_counts(gt, pred, m, "rec").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    p = ev.purity(table(spark, d, "documents"), [], "lang", "source")
    one = t.crossJoin(F.broadcast(m.agg(F.avg("score").alias("mi")))).crossJoin(F.broadcast(p))
    return one.select(rnd(sc.global_score(F.col("f1"), F.col("weighted_purity"), F.col("compression"), F.col("mi"), F.lit(None).cast("double")), 5).alias("score"))


# ---- vectors ------------------------------------------------------------------------------------------------------

CEN = """u AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM u GROUP BY label, i),
n AS (SELECT label, sqrt(sum(c * c)) + 1e-9 AS n FROM m GROUP BY label), cen AS (SELECT label, i, c / n AS c FROM m JOIN n USING (label))"""


def vectors(spark, d):
    return table(spark, d, "embeddings")


@query(f"WITH {CEN} SELECT label, CAST(i - 1 AS INT) AS pos, round(c, 6) AS value FROM cen")
def centroids(spark, d):
    return vx.centroids(vectors(spark, d), ["label"], "embedding").select("label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", rnd("value"))


@query(f"""WITH {CEN}, s AS (SELECT u.label, vec_id, round(sum(x * c), 7) AS sim FROM u JOIN cen ON cen.label = u.label AND cen.i = u.i GROUP BY u.label, vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM s)
SELECT label, vec_id, CAST(r AS INT) AS rank FROM k WHERE r <= 5""")
def representatives(spark, d):
    x = vectors(spark, d).join(F.broadcast(vx.centroids(vectors(spark, d), ["label"], "embedding")), "label").withColumn("sim", rnd(vx.dot(F.col("embedding"), F.col("centroid")), 7))
    return vx.ranked(x, ["label"], "sim", "vec_id", 5).select("label", "vec_id", "rank")


@query(f"""WITH {CEN}, s AS (SELECT vec_id, cen.label, round(sum(x * c), 7) AS sim FROM u JOIN cen ON cen.i = u.i GROUP BY vec_id, cen.label), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s)
SELECT vec_id, CASE WHEN sim >= 0.45 THEN label ELSE -1 END AS label, round(sim, 5) AS similarity FROM k WHERE r = 1""")
def prototypes_assign(spark, d):
    protos = vx.centroids(vectors(spark, d), ["label"], "embedding").select(F.col("label").alias("proto"), "centroid")
    x = vectors(spark, d).crossJoin(F.broadcast(protos)).withColumn("sim", rnd(vx.dot(F.col("embedding"), F.col("centroid")), 7))
    best = x.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("proto")).alias("p"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.sim") >= 0.45, -F.col("b.p")).otherwise(-1).alias("label"), rnd("b.sim", 5).alias("similarity"))


KNN = """q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS sim FROM q a JOIN q b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM s)"""


@query(f"WITH {KNN} SELECT src, dst, CAST(r AS INT) AS rank, round(sim, 6) AS similarity FROM k WHERE r <= 5")
def knn_edges(spark, d):
    e = vectors(spark, d)
    return vx.nearest(e, e, "vec_id", "embedding", 5).select("src", "dst", "rank", rnd("similarity").alias("similarity"))


@query("""WITH x AS (SELECT vec_id, label AS a, vec_id % 4 AS b, count(*) OVER (PARTITION BY label) AS na, count(*) OVER (PARTITION BY vec_id % 4) AS nb, count(*) OVER (PARTITION BY label, vec_id % 4) AS nab, count(*) OVER () AS n FROM embeddings) SELECT vec_id, round((n - na - nb + 2 * nab - 1) / (n - 1), 6) AS agreement FROM x""")
def coassignment(spark, d):
    x = vectors(spark, d).select("vec_id", F.col("label").alias("a"), (F.col("vec_id") % 4).alias("b"))
    return vx.coassignment(x, "a", "b").select("vec_id", rnd("agreement").alias("agreement"))


@query("""WITH x AS (SELECT vec_id, count(*) OVER (PARTITION BY label) AS n, count(*) OVER (PARTITION BY label, vec_id % 2) AS r1, count(*) OVER (PARTITION BY label, vec_id % 3) AS r2, count(*) OVER (PARTITION BY label, vec_id % 5) AS r3 FROM embeddings) SELECT vec_id, round(CASE WHEN n <= 1 THEN 1 ELSE ((r1 - 1) / (n - 1) + (r2 - 1) / (n - 1) + (r3 - 1) / (n - 1)) / 3 END, 6) AS stability FROM x""")
def ensemble_stability(spark, d):
    x = vectors(spark, d).select("vec_id", "label", *[(F.col("vec_id") % k).alias(f"r{k}") for k in (2, 3, 5)])
    return vx.persistence(x, "label", ["r2", "r3", "r5"]).select("vec_id", rnd("stability").alias("stability"))


@query(f"""WITH RECURSIVE {KNN}, e AS (SELECT src, dst FROM k WHERE r <= 1 UNION SELECT dst, src FROM k WHERE r <= 1), reach(node, other) AS (SELECT src, dst FROM e UNION SELECT reach.node, e.dst FROM reach JOIN e ON e.src = reach.other)
SELECT node, least(node, min(other)) AS label FROM reach GROUP BY node""")
def graph_components(spark, d):
    from stratalyn.plans.session import shared_dir

    shared_dir(spark)
    e = vectors(spark, d)
    return vx.propagate(vx.nearest(e, e, "vec_id", "embedding", 1)).select("node", "label")


@query(f"""WITH {CEN}, f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), c AS (SELECT f.label, i, avg(x) AS c FROM u JOIN f ON f.vec_id = u.vec_id AND f.r <= 4 GROUP BY f.label, i), n AS (SELECT label, sqrt(sum(c * c)) + 1e-9 AS n FROM c GROUP BY label),
p AS (SELECT vec_id, i, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS pn FROM u), s AS (SELECT c.label, 'p' || p.vec_id AS prompt, round(sum(c.c / n.n * p.x) / max(p.pn), 7) AS sim FROM c JOIN n USING (label) JOIN p USING (i) GROUP BY c.label, p.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, prompt DESC) AS r FROM s) SELECT label, prompt, round(sim, 5) AS similarity FROM k WHERE r = 1""".replace("n AS (SELECT label, sqrt(sum(c * c)) + 1e-9 AS n FROM m GROUP BY label), cen AS (SELECT label, i, c / n AS c FROM m JOIN n USING (label)), f", "f"))
def zero_shot_captions(spark, d):
    e = vectors(spark, d)
    prompts = e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("prompt"), "embedding")
    return tg.caption(e, prompts, ["label"], "embedding", "vec_id").select("label", "prompt", rnd("similarity", 5).alias("similarity"))


CLASSES = {"signup": "Chirp, tweet", "error": "Wind", "click": "Bee, wasp, etc.", "view": "Croak", "purchase": "Engine"}


@query(f"""WITH {DET}, n AS (SELECT rec, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in CLASSES.items())} END AS name, avg(flat) AS score FROM det GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, name) AS k FROM n),
t AS (SELECT rec, count(*) FILTER (WHERE k <= 3 AND regexp_matches(name, 'Insect|Mosquito|Cricket|Bee')) AS i, count(*) FILTER (WHERE k <= 3 AND regexp_matches(name, 'Bird|Chirp|Tweet')) AS b, count(*) FILTER (WHERE k <= 3 AND regexp_matches(name, 'Frog|Croak')) AS f, count(*) FILTER (WHERE k <= 3 AND contains(name, 'Wind')) AS w, string_agg(name, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top,
  coalesce(max(score) FILTER (WHERE name IN ('Chirp, tweet', 'Bee, wasp, etc.', 'Croak')), 0) AS bio, coalesce(max(score) FILTER (WHERE name IN ('Wind', 'Engine')), 0) AS noise FROM r GROUP BY rec)
SELECT rec, top, round(bio, 6) AS bio_score, round(noise, 6) AS noise_score, CASE WHEN i > 0 THEN 'insect_sustained' WHEN b > 0 THEN 'bird_calls' WHEN f > 0 THEN 'amphibian' WHEN w > 0 THEN 'wind_dominant' WHEN bio > noise THEN 'general_animal' ELSE 'background_dominant' END AS hint FROM t""")
def semantic_tags(spark, d):
    name = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in CLASSES.items()])
    one = detections(spark, d).select("rec", "event_id", F.array(F.struct(name.alias("name"), F.col("flat").alias("score"))).alias("scores"))
    top = tg.window_tags(tg.top_classes(one, ["rec"], "scores", 5, "event_id"), "top")
    return top.select("rec", F.array_join(F.transform(F.slice("top", 1, 3), lambda x: x["name"]), ",").alias("top"), rnd("bio_score").alias("bio_score"), rnd("noise_score").alias("noise_score"), tg.hint(F.col("top"), F.col("bio_score"), F.col("noise_score")).alias("hint"))


@query(f"WITH {KNN} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(least(greatest(sim, 0), 2)), 5) AS weight FROM k WHERE r <= 5 GROUP BY 1, 2")
def edge_weights(spark, d):
    e = vectors(spark, d)
    w = sc.weight(1 - F.col("similarity"))
    near = vx.nearest(e, e, "vec_id", "embedding", 5)
    return near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(rnd(F.sum(w), 5).alias("weight"))


# ---- windows, times, strings --------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars <= 1000 THEN 1 ELSE (n_chars - 1000) // 400 + 2 END AS k FROM documents), w AS (SELECT doc_id, n, unnest(range(0, k)) AS w FROM r)
SELECT doc_id, w AS "window", w * 400 AS first_sample, greatest(0, w * 400 + 1000 - n) AS padding FROM w""")
def window_grid(spark, d):
    return fr.window_grid(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1000, 400).select("doc_id", "window", "first_sample", "padding")


@query(f"""WITH {DET}, p AS (SELECT rec, s AS t, flat AS v FROM det WHERE event_type = 'signup'),
x AS (SELECT d.rec, d.event_id, d.s, (SELECT max_by(v, t) FROM p WHERE p.rec = d.rec AND p.t <= d.s) AS v0, (SELECT max(t) FROM p WHERE p.rec = d.rec AND p.t <= d.s) AS t0, (SELECT min_by(v, t) FROM p WHERE p.rec = d.rec AND p.t >= d.s) AS v1, (SELECT min(t) FROM p WHERE p.rec = d.rec AND p.t >= d.s) AS t1 FROM det d WHERE event_type = 'click'),
y AS (SELECT rec, event_id, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * coalesce((s - t0) / nullif(t1 - t0, 0), 0) END AS v FROM x)
SELECT rec, event_id, round(v, 6) AS score, coalesce(v >= 0.5, false) AS pass FROM y""")
def asof_gate(spark, d):
    x = detections(spark, d)
    pts = x.where("event_type = 'signup'").select("rec", "s", F.col("flat").alias("v"))
    g = fr.interpolate(x.where("event_type = 'click'").select("rec", "event_id", "s"), pts, ["rec"], "s", "v", "score")
    return g.select("rec", "event_id", rnd("score").alias("score"), F.coalesce(F.col("score") >= 0.5, F.lit(False)).alias("pass"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, list_extract(string_split(url, '/'), -1) AS base, printf('page_%06d', page_id) AS ident, CASE WHEN contains(lower(url), 'val') THEN 'validation' WHEN contains(lower(url), 'train') THEN 'train' ELSE 'all' END AS split, printf('cluster_%03d', page_id % 40) AS folder FROM pages""")
def strings_paths(spark, d):
    p = with_split(table(spark, d, "pages"), "url")
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "").alias("slug"), F.substring_index("url", "/", -1).alias("base"), F.format_string("page_%06d", "page_id").alias("ident"), "split", F.format_string("cluster_%03d", F.col("page_id") % 40).alias("folder"))


@query("""SELECT event_id, strftime(make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS ends_at, strftime(ts, '%Y-%m-%d') AS day, try_cast('x' || event_id AS DOUBLE) IS NULL AS bad FROM events""")
def clip_times(spark, d):
    e = table(spark, d, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000).cast("long") * 1000000)
    return e.select("event_id", F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss").alias("ends_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("try_cast(concat('x', event_id) as double)").isNull().alias("bad"))


@query("""SELECT user_id AS rec, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id""")
def json_metadata(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("rec")).agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"), types.alias("types"))


@query("""SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END), '') AS name, try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS INT) AS number, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN true ELSE false END AS flag FROM customer""")
def form_coercion(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.nullif(F.trim(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name"))), F.lit("")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).try_cast("int").alias("number"), F.lower("c_mktsegment").isin("building", "machinery").alias("flag"))


@query("""SELECT substr(sha256(p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)), 1, 16) AS fingerprint, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1""")
def fingerprint_dedup(spark, d):
    key = F.left(F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).cast("binary"), 256), F.lit(16))
    return table(spark, d, "part").groupBy(key.alias("fingerprint")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n, round(sum(value), 5) AS total FROM g GROUP BY user_id, k""")
def session_window(spark, d):
    from stratalyn.streaming.windows import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts", "6 hours").select("user_id", "begins", "ends", "n", rnd("total", 5).alias("total"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, d):
    from stratalyn.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"]).select("begins", "event_type", "n", rnd("total", 5).alias("total"))


@query(f"""WITH {DET} SELECT rec, event_type, count(*) AS n, round(sum(value), 4) AS total FROM det GROUP BY ROLLUP (rec, event_type)""")
def rollup_counts(spark, d):
    return detections(spark, d).rollup("rec", "event_type").agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


CLUSTERED = """ev AS (SELECT o_orderkey AS event_id, o_custkey AS cluster_id, o_totalprice AS score, CASE o_orderpriority WHEN '1-URGENT' THEN 'low_confidence_noise' WHEN '2-HIGH' THEN 'short_review' ELSE 'original' END AS route FROM orders),
meta AS (SELECT l_orderkey AS event_id, max(l_returnflag) AS mode FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)"""


def clustered(spark, d):
    route = F.when(F.col("o_orderpriority") == "1-URGENT", "low_confidence_noise").when(F.col("o_orderpriority") == "2-HIGH", "short_review").otherwise("original")
    e = table(spark, d, "orders").select(F.lit("r").alias("recording_id"), F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_totalprice").alias("score"), route.alias("route"))
    meta = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_returnflag").alias("mode"))
    return e, meta.withColumn("recording_id", F.lit("r"))


@query(f"WITH {CLUSTERED} SELECT ev.event_id, route, mode, mode IS NOT NULL AS described FROM ev LEFT JOIN meta ON meta.event_id = ev.event_id")
def event_metadata(spark, d):
    e, meta = clustered(spark, d)
    out = service.described(e, meta, ["recording_id", "event_id"])
    return out.select("event_id", "route", F.col("metadata.mode").alias("mode"), F.col("metadata").isNotNull().alias("described"))


@query(f"""WITH {CLUSTERED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, event_id) AS k FROM ev)
SELECT cluster_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE k <= 2) AS representatives FROM r GROUP BY cluster_id""")
def cluster_events(spark, d):
    e, _ = clustered(spark, d)
    top = vx.ranked(e, ["recording_id", "cluster_id"], "score", "event_id", 2).groupBy("recording_id", "cluster_id").agg(F.array_join(F.collect_list(F.col("event_id").cast("string")), ",").alias("representative_event_ids"))
    out = service.with_events(top, e)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["event_id"].cast("string")), ",")
    return out.select("cluster_id", F.size("events").cast("long").alias("n"), ids(F.col("events")).alias("events"), ids(F.col("representatives")).alias("representatives"))


@query(f"WITH {CLUSTERED} SELECT route, count(*) AS n_events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_ids FROM ev WHERE route <> 'original' GROUP BY route")
def review_folders(spark, d):
    e, _ = clustered(spark, d)
    return rt.by_bucket(e, ["recording_id"]).select("route", "n_events", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


@query(f"WITH {DET} SELECT event_id, CASE WHEN comp THEN printf('%d_component_%d__%.3f-%.3f', parent, event_id % 3, s, e) ELSE printf('%d__%.3f-%.3f', event_id, s, e) END AS stem FROM det")
def file_stems(spark, d):
    x = detections(spark, d).select(F.col("event_id"), F.when(F.col("comp"), F.col("parent")).alias("parent_event_id"), F.when(F.col("comp"), F.col("event_id") % 3).alias("component_id"), F.col("comp").alias("is_component"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec"))
    return x.select("event_id", service.file_stem().alias("stem"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Routed detections of every recording: how many each bucket holds, beside the detection figures."""
    return route_partition(spark, d).join(detection_metrics(spark, d), "rec", "left")
