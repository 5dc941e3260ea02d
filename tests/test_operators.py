"""Order-dependent operators against plain Python, and the edges of the rest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratalyn.functions import scores as sc
from stratalyn.operators import evaluation as ev
from stratalyn.operators import frames as fr
from stratalyn.operators import intervals as iv
from stratalyn.operators import routing as rt
from stratalyn.operators import vectors as vx


def iou(a, b):
    hull = max(a[1], b[1]) - min(a[0], b[0])
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull if hull > 0 else 0.0


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(3)
    out = []
    for rec in "ab":
        for i in range(60):
            s = round(r.uniform(0, 60), 2)
            out.append((rec, i, s, round(s + r.choice([0.0, 0.5, 2.0, 5.0]), 2), r.choice([0.1, 0.5, 0.5, 0.9]), r.choice([None, "p", "q"])))
    return out, spark.createDataFrame(out, "rec string, id int, s double, e double, score double, parent string")


@pytest.mark.parametrize("parent", [None, "parent"])
def test_suppression_is_the_greedy_loop(spans, parent):
    data, df = spans
    want = set()
    for rec in "ab":
        kept = []
        for x in sorted((x for x in data if x[0] == rec), key=lambda x: (-x[4], x[1])):
            if not any(iou(x[2:4], k[2:4]) >= 0.3 and not (parent and x[5] is not None and x[5] == k[5]) for k in kept):
                kept.append(x)
        want |= {x[:2] for x in kept}
    got = iv.suppress(df, ["rec"], "s", "e", "id", [-F.col("score")], 0.3, parent)
    assert {(r.rec, r.id) for r in got.collect()} == want
    assert iv.suppress(df, ["rec"], "s", "e", "id", [-F.col("score")], 1.0).count() == len(data)


def test_merging_twice_changes_nothing(spans):
    once = iv.merge(spans[1], ["rec"], "s", "e", 0.5)
    twice = iv.merge(once.drop("n"), ["rec"], "s", "e", 0.5)
    assert sorted((r.rec, r.s, r.e) for r in once.collect()) == sorted((r.rec, r.s, r.e) for r in twice.collect())


def test_runs_break_at_labels_gaps_noise_and_length(spark):
    data = [(0, 0.0, 1), (1, 1.0, 1), (2, 2.0, 2), (3, 3.0, -1), (4, 4.0, 2), (5, 9.0, 2), (6, 10.0, 2), (7, 11.0, 2), (8, 12.0, 2)]
    df = spark.createDataFrame([("r", *x) for x in data], "rec string, i int, s double, label int")
    got = iv.runs(df, ["rec"], "s", "label", "i", 2.0, 1.0, 4.0, 0.0)
    assert sorted(r.windows for r in got.collect()) == [[0, 1], [2], [4], [5, 6, 7], [8]]


def test_overlap_ratio_counts_covered_frames(spark):
    df = spark.createDataFrame([("p", 0, 3), ("p", 2, 5), ("q", 1, 1)], "k string, a long, b long")
    assert {r.k: round(r.overlap_ratio, 6) for r in iv.overlap_ratio(df, ["k"], "a", "b").collect()} == {"p": round(2 / 6, 6), "q": 0.0}


def test_matching_is_one_to_one(spark):
    r = random.Random(5)
    gt = [("f", i, s := r.uniform(0, 50), s + r.uniform(0.5, 4)) for i in range(40)]
    pr = [("f", i, s := r.uniform(0, 50), s + r.uniform(0.5, 6)) for i in range(60)]
    g, p = spark.createDataFrame(gt, "rec string, gt_id int, gs double, ge double"), spark.createDataFrame(pr, "rec string, pred_id int, ps double, pe double")
    got = {(x.gt_id, x.pred_id) for x in ev.assign(ev.candidates(g, p, "rec", 0.3, 0.5, 7.0), "rec").collect()}
    pairs = []
    for a in gt:
        for b in pr:
            cover = max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / (a[3] - a[2])
            if (i := iou(a[2:], b[2:])) >= 0.3 or cover >= 0.5:
                pairs.append((-max(i, cover), a[1], b[1]))
    want, used = set(), (set(), set())
    for _, a, b in sorted(pairs):
        if a not in used[0] and b not in used[1]:
            want.add((a, b))
            used[0].add(a)
            used[1].add(b)
    assert got == want


def test_rates_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    r = ev.with_rates(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_parents_collapse_and_precision_rises(spark):
    rows = [("f", "a", "p", 0.0, 1.0, 0.5, "component"), ("f", "b", "p", 0.5, 2.0, 0.7, "component"), ("f", "c", None, 5.0, 6.0, 0.2, "original")]
    df = spark.createDataFrame(rows, "file_id string, event_id string, parent_event_id string, start_sec double, end_sec double, detection_score double, source_type string")
    got = {r.prediction_id: (r.start_sec, r.end_sec, r.detection_score, r.source_type) for r in ev.collapse_parents(df).collect()}
    assert got == {"p": (0.0, 2.0, 0.7, "parent_aggregated"), "c": (5.0, 6.0, 0.2, "original")}


def test_the_view_leaves_review_buckets_out(spark):
    df = spark.createDataFrame([(1, "original"), (2, "mixed"), (3, None), (4, "short_review")], "id int, source_type string")
    assert {r.id for r in ev.evaluation_view(df).collect()} == {1, 3}


def test_agreement_matches_definitions(spark):
    same = spark.createDataFrame([(x, x) for x in "aabbcc"], "l string, c string")
    r = ev.agreement(same, "l", "c").first()
    assert math.isclose(r.nmi, 1.0) and math.isclose(r.ari, 1.0)


def test_routing_loses_nothing_and_keeps_the_first_route(spark):
    df = spark.createDataFrame([(i, i / 10, i / 20) for i in range(20)], "id int, dur double, clu double")
    x = rt.finish(rt.route_clusterability(rt.route_short(rt.start(df), "dur"), "clu"))
    rows = {r.id: r for r in x.collect()}
    assert len(rows) == 20 and rows[0].route == "short_review" and rows[0].route_reason == "short_event:<0.200s"
    assert rows[3].route == "low_confidence_noise" and rows[8].route == "ambiguous_review" and rows[15].clusterable


def test_null_and_nan_take_their_default(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.25,)], "x double")
    assert [r.y for r in df.select(sc.safe(F.col("x"), 0.5).alias("y")).collect()] == [0.5, 0.5, 0.5, 0.25]
    assert df.select(sc.smoothstep(1, 1, F.lit(1.0)).alias("y")).first().y == 1.0


def test_rolling_rank_repeats_the_edges(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])], "k string, i int, v double")
    got = {r.i: r.f for r in fr.rolling_rank(df, ["k"], ["i"], "v", 3, 50, "f").collect()}
    assert got == {0: 5.0, 1: 4.0, 2: 2.0, 3: 3.0, 4: 3.0}


def test_windows_cover_the_recording(spark):
    df = spark.createDataFrame([(1, 300), (2, 2500), (3, 2000)], "id int, n long")
    got = {}
    for r in fr.window_grid(df, "n", 1000, 500).collect():
        got.setdefault(r.id, []).append((r.first_sample, r.padding))
    assert sorted(got[1]) == [(0, 700)] and sorted(got[2])[-1] == (2000, 500) and len(got[3]) == 4


def test_interpolation_holds_the_ends(spark):
    pts = spark.createDataFrame([("r", 1.0, 10.0), ("r", 3.0, 30.0)], "k string, t double, v double")
    df = spark.createDataFrame([("r", 0.0), ("r", 2.0), ("r", 3.0), ("r", 9.0)], "k string, t double")
    assert {r.t: r.o for r in fr.interpolate(df, pts, ["k"], "t", "v", "o").collect()} == {0.0: 10.0, 2.0: 20.0, 3.0: 30.0, 9.0: 30.0}


def test_coassignment_is_the_pairwise_form(spark):
    a, b = [0, 0, 1, 1, 1, 2], [0, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i int, a int, b int")
    for r in vx.coassignment(df, "a", "b").collect():
        want = sum((a[r.i] == a[j]) == (b[r.i] == b[j]) for j in range(6) if j != r.i) / 5
        assert math.isclose(r.agreement, want)


def test_neighbours_agree_between_broadcast_and_blocks(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(40)], "id int, v array<double>")
    one, many = vx.nearest(df, df, "id", "v", 3), vx.nearest(df, df, "id", "v", 3, size_bound=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_groups_of_a_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11)], "src int, dst int")
    assert {r.node: r.label for r in vx.propagate(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}


def test_stream_and_batch_windows_agree(spark, tmp_path):
    from stratalyn.streaming import windows as sw

    rows = [(1, f"2024-01-01 00:{m:02}:00", float(m)) for m in (0, 5, 40, 45)] + [(2, "2024-01-01 00:10:00", 1.0), (2, "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id int, t string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = sw.run_available(sw.tumbling(stream, "ts", "10 minutes", ["user_id"], "1 minute"), str(tmp_path / "tumbled"), str(tmp_path / "cp"), "complete")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(out) == key(sw.tumbling(df, "ts", "10 minutes", ["user_id"]))
    assert sw.sessions(df, "user_id", "ts", "10 minutes").count() == 4


def test_captions_compare_all_prompts_in_blocks(spark):
    import numpy as np

    from stratalyn.operators import tagging

    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    df = spark.createDataFrame([(i, i % 7, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, label long, embedding array<double>")
    prompts = df.selectExpr("concat('p', vec_id) AS prompt", "embedding").repartition(8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tagging.caption(df, prompts, ["label"], "embedding", "vec_id")
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        best = {row.label: row.prompt for row in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for label in range(7):
        mean = x[label::7][:4].mean(axis=0)
        like = np.round(x @ (mean / (np.linalg.norm(mean) + 1e-9)) / np.linalg.norm(x, axis=1), 7)
        assert best[label] == max((v, f"p{i}") for i, v in enumerate(like))[1]


def slow_kept(rows, threshold):
    kept = []
    for s, e, p, i in rows:
        if not any((min(e, f) - max(s, a)) / (max(e, f) - min(s, a)) >= threshold and (p is None or p != q) for a, f, q, _ in kept if min(e, f) > max(s, a)):
            kept.append((s, e, p, i))
    return {i for *_, i in kept}


def test_suppression_of_large_islands_is_that_of_small_ones(spark, monkeypatch):
    import random
    import time

    from stratalyn.operators import intervals

    r = random.Random(6)
    rows = [("r", i, float(i % 700) + r.random(), r.random(), str(r.randrange(40)) if i % 3 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "rec string, id long, s double, score double, p string").withColumn("e", F.col("s") + 2 + F.col("id") % 5)
    ordered = sorted(((s, s + 2 + i % 5, p, i, sc) for _, i, s, sc, p in rows), key=lambda x: (-x[4], x[3]))
    want = slow_kept([x[:4] for x in ordered], 0.4)
    for small in (10**9, 64, 2):
        monkeypatch.setattr(intervals, "SMALL", small)
        got = {x.id for x in intervals.suppress(df, ["rec"], "s", "e", "id", [-F.col("score")], 0.4, "p").collect()}
        assert got == want
    monkeypatch.setattr(intervals, "SMALL", 64)
    chain = spark.range(20_000).select(F.lit("r").alias("rec"), "id", (F.col("id") * 0.5).alias("s"), (F.col("id") * 0.5 + 1).alias("e"), F.rand(3).alias("score"))
    began = time.time()
    assert 6_000 < intervals.suppress(chain, ["rec"], "s", "e", "id", [-F.col("score")], 0.3).count() < 20_000
    assert time.time() - began < 60
    assert intervals.suppress(df.limit(0), ["rec"], "s", "e", "id", [-F.col("score")], 0.4).count() == 0


def test_runs_and_matches_of_large_groups(spark, monkeypatch):
    from stratalyn.operators import evaluation, intervals

    df = spark.range(500).select(F.lit("r").alias("rec"), "id", (F.col("id") * 1.0).alias("s"), (F.col("id") % 50 < 45).cast("int").alias("label"))
    pairs = spark.range(400).select(F.lit("r").alias("rec"), (F.col("id") % 20).alias("gt_id"), (F.col("id") % 23).alias("pred_id"), F.rand(5).alias("score"), F.rand(6).alias("iou"), (F.col("id") % 20 * 1.0).alias("gs"), (F.col("id") % 20 + 30.0).alias("ge"), (F.col("id") % 23 * 1.0).alias("ps"), (F.col("id") % 23 + 31.0).alias("pe")).dropDuplicates(["gt_id", "pred_id"]).checkpoint()
    found = []
    for small in (10**9, 3):
        monkeypatch.setattr(intervals, "SMALL", small)
        monkeypatch.setattr(evaluation, "SMALL", small)
        found.append((sorted(map(str, intervals.runs(df, ["rec"], "s", "label", "id", 2.0, 1.0, 12.0, 1.0).collect())), sorted(map(str, evaluation.assign(pairs, "rec").collect()))))
    assert found[0] == found[1] and len(found[0][1]) == 20


def test_originals_and_parents_of_one_id_stay_apart(spark):
    rows = [("f", "p1", None, 0.0, 1.0, 0.5, "original", "x"), ("f", "c1", "p1", 2.0, 3.0, 0.2, "component", "y"), ("f", "c2", "p1", 2.5, 4.0, 0.9, "component", "z"), ("f", "c3", "", 5.0, 6.0, 0.1, "original", "w")]
    df = spark.createDataFrame(rows, "file_id string, event_id string, parent_event_id string, start_sec double, end_sec double, detection_score double, source_type string, note string")
    got = sorted((r.prediction_id, r.start_sec, r.end_sec, r.detection_score, r.source_type, r.note, r.n_members) for r in ev.collapse_parents(df).collect())
    assert got == [("c3", 5.0, 6.0, 0.1, "original", "w", 1), ("p1", 0.0, 1.0, 0.5, "original", "x", 1), ("p1", 2.0, 4.0, 0.9, "parent_aggregated", "y", 2)]


def test_audit_prompts_and_attached_columns(spark):
    from stratalyn.operators import tagging

    df = spark.createDataFrame([(f"f{i}", float(i % 5) if i else None) for i in range(9)], "feature string, separation double")
    assert [r.feature for r in ev.audit_top(df, 3).collect()] == ["f4", "f3", "f8"]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(1, "p", "q"), (1, "o", "z")], "id int, y string, x string")
    assert sorted(tuple(r) for r in ev.attach(left, right, ["id"]).collect()) == [(1, "a", "o"), (2, "b", None)]
    table = tagging.prompt_table(spark, lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert len(table) == 13 and table[0][:] == ("a bird call", [11.0, 1.0])


def test_polyphony_needs_its_columns(spark):
    df = spark.createDataFrame([("f", "original")], "file_id string, source_type string")
    assert ev.polyphony(df).first().enabled is False and ev.polyphony(df).first().n_original == 0


def test_neighbours_in_blocks_are_exact(spark):
    import numpy as np

    from stratalyn.operators import vectors

    x = np.random.default_rng(1).normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -9)
    want = {(i, int(j)) for i in range(90) for j in sorted(range(90), key=lambda j: (-sim[i, j], j))[:4]}
    for bound in (1 << 30, 8 * 8 * 13):
        assert {(r.src, r.dst) for r in vectors.nearest(df, df, "id", "v", 4, bound).collect()} == want
    assert vectors.ensemble_variants(9, 15, 0.1, 10, 5)[0] == {"neighbours": 10, "distance": 0.0, "least": 5, "samples": 1}


def test_three_decimals_round_the_exact_value(spark):
    from stratalyn.sources.service import three_decimals

    r = random.Random(5)
    x = [0.0625, 0.1875, 1.0005, 0.9995, 0.0005, 1704350726.3925, 1704103775.1185, -0.0625, -0.0001, -0.0, 0.0, 1e-320, 2.0**52 + 1, 1e17, 4e18, float("inf"), float("-inf"), float("nan")]
    x += [r.randrange(10**13) / 10_000 for _ in range(300)] + [r.randrange(1 << 40) / (1 << r.randrange(45)) for _ in range(300)] + [-r.random() * 10 ** r.randrange(-5, 12) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x, None])], "i int, x double")
    got = dict(df.select("i", three_decimals(F.col("x"))).collect())
    assert [got[i] for i in range(len(x) + 1)] == [*(f"{v:.3f}" for v in x), None]


def test_noise_modes_keep_a_score_at_their_limit(spark):
    df = spark.createDataFrame([("conservative", 0.7), ("exploratory", 0.43), ("balanced", 0.55)], "mode string, q double")
    one = lambda q, *a: sc.low_confidence(q, F.lit(9.0), F.lit(0.1), F.lit(0.5), *a)
    for r in df.select("mode", "q", one(F.col("q"), F.col("mode")).alias("low"), one(F.col("q") - 1e-9, F.col("mode")).alias("below")).collect():
        assert (r.low, r.below) == (False, True)
        assert spark.range(1).select(one(F.lit(r.q), r.mode).alias("low")).first().low is False


def test_means_in_order_do_not_depend_on_the_dealing(spark):
    from stratalyn.operators import tagging

    r = random.Random(7)
    rows = [(k, i, r.randrange(97) / 97) for k in range(40) for i in range(50)]
    want = {}
    for k, _, v in rows:
        want[k] = want.get(k, 0.0) + v
    df = spark.createDataFrame([*rows, (0, 99, None)], "k int, i int, v double")
    for parts in (1, 7):
        got = df.repartition(parts, "i").groupBy("k").agg(fr.mean_in_order(F.col("v"), F.col("i")).alias("m")).collect()
        assert {x.k: x.m for x in got} == {k: v / 50 for k, v in want.items()}
    assert df.where("v is null").agg(fr.mean_in_order(F.col("v"), F.col("i")).alias("m")).first().m is None
    # 0.1 + 0.2 + 0.3 is above 0.3 + 0.2 + 0.1: the order of the rows decides between the classes
    one = spark.createDataFrame([("r", i, [(n, v)]) for n, vs in (("a", (0.3, 0.2, 0.1)), ("b", (0.1, 0.2, 0.3))) for i, v in enumerate(vs)], "rec string, i int, s array<struct<name: string, score: double>>")
    for parts in (1, 5):
        assert [x.name for x in tagging.top_classes(one.repartition(parts, "i"), ["rec"], "s", 2, "i").first().top] == ["b", "a"]


def test_best_columns_are_exact_and_need_many_tasks(spark):
    import numpy as np

    r = np.random.default_rng(4)
    names = np.array([0, 1, 1, 4, 5, 7, 8, 9])
    sim = np.round(r.random((6, 8)), 1) + r.random((6, 8)) * 1e-10
    sim[2], sim[3, 4] = np.nan, np.nan
    src = np.array([1, 4, 5, 6, 9, 0])
    want = []
    for i in range(6):
        each = sorted((-round(sim[i, j], 9), j) for j in range(8) if names[j] != src[i] and not np.isnan(sim[i, j]))
        want += [(i, j, -v) for v, j in each[:3]]
    assert list(zip(*(x.tolist() for x in vx.best(sim.copy(), src, names, 3)))) == want
    df = spark.range(5000).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v"))
    assert vx.nearest(df, df, "id", "v", 2).where("rank = 1").select(F.countDistinct("src")).first()[0] == 5000
    # three blocks a side, where one task held them all
    assert "RepartitionByExpression [block" in vx.nearest(df, df, "id", "v", 2)._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_by_single_precision_are_those_of_double_precision(spark):
    import numpy as np

    r = np.random.default_rng(6)
    base = r.normal(size=(5000, 8))
    copies = base[r.integers(0, 30, 5000)]
    near = np.where(r.random((5000, 1)) < 0.5, base[0] + r.normal(size=(5000, 8)) * 1e-7, base)
    holes = base.copy()
    holes[::7], holes[3, 2], holes[5, 1] = 0, np.nan, np.inf
    twice = np.sort(r.integers(0, 2000, 5000))
    for t, names in ((base, np.arange(5000)), (copies, np.arange(5000)), (near, np.arange(5000)), (holes, np.arange(5000)), (base, twice), (base[:3], np.arange(3))):
        with np.errstate(all="ignore"):
            t = t / np.linalg.norm(t, axis=1, keepdims=True)
        at = np.sort(r.integers(0, len(t), 200))
        q, src = t[at], names[at] + (at % 3 == 0)
        mine, want = vx.closest(q, src, t, names, 4), vx.best(q @ t.T, src, names, 4)
        assert all(np.array_equal(a, b) for a, b in zip(mine[:2], want)) and np.allclose(mine[2], want[2], rtol=0, atol=2e-9)
    with pytest.raises(Exception, match="one width"):
        vx.nearest(df := spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [1.0] * 3)], "id int, v array<double>"), df, "id", "v", 1).collect()


def test_groups_in_one_task_and_in_rounds_agree(spark):
    import numpy as np

    r = np.random.default_rng(7)
    name = r.permutation(400)
    a, b = [*name[:30], *name[210:240], 900, 903], [*name[1:31], *r.permutation(name[210:240]), 900, 902]
    nodes, labels = vx.groups(np.array(a), np.array(b))
    top = {int(n): int(n) for n in {*a, *b}}
    for _ in top:
        for x, y in zip(a, b):
            top[x] = top[y] = min(top[x], top[y])
    assert dict(zip(nodes.tolist(), labels.tolist())) == top
    e = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "src long, dst long")
    for bound in (len(a), len(a) - 1):
        assert {x.node: x.label for x in vx.propagate(e, bound=bound).collect()} == top
    assert "MapInArrow" in vx.propagate(e)._jdf.queryExecution().optimizedPlan().toString()  # no rounds
    assert vx.propagate(e.limit(0)).count() == 0
    words = spark.createDataFrame([("b", "é"), ("z", "é"), ("a", "q"), (None, "q")], "src string, dst string")
    assert {x.node: x.label for x in vx.propagate(words).collect()} == {"b": "b", "é": "b", "z": "b", "a": "a", "q": "a"}
