"""Kernels against analytic signals, sources and sinks, and both pipelines from WAV files to tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalyn.config import DiscoveryConfig, WindowConfig, adapted, described, fingerprint, from_form, variants
from stratalyn.functions import kernels as k
from stratalyn.functions import plugins
from stratalyn.plans import discovery, window_graph
from stratalyn.sources import recordings as src
from stratalyn.sources import results as res
from stratalyn.sources import service

RATE = 16000


def tone(freq, seconds, rate=RATE, amp=0.5):
    t = np.arange(int(seconds * rate)) / rate
    return amp * np.sin(2 * np.pi * freq * t) * np.hanning(len(t)) ** 0.2


def scene(seconds, parts, rate=RATE, noise=0.003, seed=1):
    x = np.random.default_rng(seed).normal(0, noise, int(seconds * rate))
    for at, y in parts:
        x[int(at * rate) : int(at * rate) + len(y)] += y
    return x.astype(np.float32)


def test_short_time_transform_is_inverted():
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(k.istft(k.stft(x, 512, 128), 512, 128, 5000)[300:-300], x[300:-300], atol=1e-6)


def test_descriptors_of_known_signals():
    s = np.abs(k.stft(tone(1000, 1.0), 1024, 256))
    assert abs(np.median(k.centroid_bandwidth(s, RATE)[0]) - 1000) < 60 and k.tonality(s) > 0.6
    n = np.abs(k.stft(np.random.default_rng(0).normal(size=RATE), 1024, 256))
    assert np.median(k.flatness(n)) > 0.4 > np.median(k.flatness(s))
    x = np.arange(RATE) / RATE
    low = k.band_pass(np.sin(2 * np.pi * 200 * x) + np.sin(2 * np.pi * 4000 * x), RATE, 100, 800)
    assert abs(np.std(low) - np.sqrt(0.5)) < 0.02
    assert len(k.embedding(tone(700, 0.4), RATE)) == 589 and not np.isnan(k.embedding(np.zeros(10, np.float32), RATE)).any()
    assert len(k.resample(x, RATE, 8000)) == 8000


def test_labels_of_connected_cells():
    m = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 0, 1], [0, 1, 1, 1]], bool)
    lab, n = k.label_2d(m)
    assert n == 2 and lab[0, 0] == lab[1, 0] and lab[3, 1] == lab[0, 2] != lab[0, 0]


def test_morphology_and_intervals():
    m = np.array([0, 1, 0, 1, 1, 1, 0, 0, 1, 1, 1, 0], bool)
    assert k.opened_closed(m, 3, 1).tolist() == [False, False, False, True, True, True, False, False, True, True, True, False]
    assert k.opened_closed(m, 3, 3)[6:8].tolist() == [True, True] or k.opened_closed(m, 3, 4)[6:8].all()
    assert k.intervals(np.array([1, 1, 0, 1], bool), 0.5, 1.9) == [(0.0, 1.0), (1.5, 1.9)]


def test_refinement_tightens_a_wide_event():
    x = scene(1.4, [(0.55, tone(2000, 0.35))])
    a, b = k.refine_energy(x, RATE)
    assert 0.4 < a < 0.6 and 0.85 < b < 1.1
    a, b = k.refine_envelope(x, RATE)
    assert 0.4 < a < 0.65 and b < 1.1


def test_clusters_and_groups_of_two_blobs():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.2, (20, 3)), r.normal(5, 0.2, (20, 3))])
    labels, p = k.density_clusters(x, 5, 3)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1] and (p <= 1).all()
    a = [(i, j) for g in (range(6), range(6, 12)) for i in g for j in g if i < j] + [(0, 6)]
    g = k.modularity_groups(np.array([i for i, _ in a]), np.array([j for _, j in a]), np.ones(len(a)), 12)
    assert len(set(g[:6])) == len(set(g[6:])) == 1 and g[0] != g[-1]


def test_configuration_is_checked_and_hashed():
    with pytest.raises(ValueError):
        DiscoveryConfig(min_quality=2)
    assert fingerprint(DiscoveryConfig()) == fingerprint(DiscoveryConfig()) != fingerprint(DiscoveryConfig(hop=256))
    assert len(variants(DiscoveryConfig())) == 6 and len(variants(DiscoveryConfig(), "balanced")) == 9
    with pytest.raises(ValueError):
        plugins.find(plugins.ENCODERS, "none")


def test_wav_round_trip_and_errors():
    x = scene(0.5, [])
    y, rate = src.parse_wav(src.write_wav(x, RATE))
    assert rate == RATE and np.abs(y - (x - x.mean())).max() < 1e-3
    for bad in (b"", b"RIFFxxxxWAVE", src.write_wav(x[:0], RATE)):
        with pytest.raises(ValueError):
            src.parse_wav(bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("rec")
    (d / "a.wav").write_bytes(src.write_wav(scene(12, [(t, tone(2500, 0.4)) for t in (1, 4, 7, 10)] + [(t, tone(600, 0.5)) for t in (2.5, 5.5, 8.5)]), RATE))
    (d / "b.wav").write_bytes(src.write_wav(scene(6, [(1.0, tone(500, 0.5)), (1.0, tone(3500, 0.5))], seed=2), RATE))
    (d / "broken.wav").write_bytes(b"no")
    return d


def test_interval_pipeline(spark, folder, tmp_path):
    c = DiscoveryConfig(rate=RATE, frame=1024, hop=256, min_cluster=2)
    loaded = src.load(spark, str(folder), RATE)
    assert loaded.where("error is not null").count() == 1
    events, clusters = discovery.run(loaded, c)
    events = events.cache()
    rows = events.collect()
    a = [r for r in rows if r.recording_id == "a"]
    assert 5 <= len(a) <= 14 and all(r.route in res.BUCKETS for r in rows) and any(r.clusterable for r in a)
    assert all(abs(r.start_sec - round(r.start_sec * 2) / 2) < 0.4 for r in a)
    assert clusters.count() >= 1 and clusters.first().representative_event_ids
    res.write_events(events, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/events")).count() == len(rows)
    doc = json.loads(res.metadata(events, "2024-05-01T10:00:00+02:00", {"id": 1}).where("recording_id = 'a'").first().document)
    assert len(doc["events"]) == len(a) and doc["recording"]["start"].endswith("+02:00") and doc["events"][0]["clip_timing"]["absolute_start"]
    counts = [r.asDict() for r in res.run_metadata(events, fingerprint(c)).collect()]
    assert "| a |" in res.report(counts) and "<table>" in res.review_page(events)
    assert res.pending(loaded, events, fingerprint(c)).select("recording_id").collect()[0][0] == "broken"
    assert res.png(scene(0.3, []), RATE)[:4] == b"\x89PNG"


def test_bands_find_what_full_band_votes_miss():
    c = DiscoveryConfig(rate=RATE, frame=1024, hop=256)
    t = np.arange(10 * RATE) / RATE
    x = scene(10, [(5.0, tone(5000, 0.5, amp=0.05))], noise=0.0005) + k.band_pass(np.random.default_rng(3).normal(0, 1.0, len(t)), RATE, 100, 700).astype(np.float32)
    near = lambda cfg: [d for d in discovery.detect(x, RATE, cfg) if d["start"] > 4.3 and d["end"] < 6.2 and d["start"] < 5.3 < d["end"]]
    assert near(c) and not near(DiscoveryConfig(rate=RATE, frame=1024, hop=256, multiband=False))


def test_components_have_their_own_times_and_pass_the_gate(spark):
    c = DiscoveryConfig(rate=RATE, frame=1024, hop=256, max_event=8.0)
    x = scene(6, [(1.0, tone(500, 1.0)), (1.7, tone(3500, 1.0))], noise=0.0005)
    docs = spark.createDataFrame([("r", RATE, bytearray(x.tobytes()))], "recording_id string, sample_rate int, samples binary")
    found = [r for r in discovery.detections(docs, c).collect() if r.is_component]
    assert len(found) == 2
    low, high = sorted(found, key=lambda r: r.spectral_centroid)
    assert low.end_sec < 2.3 and high.start_sec > 1.4 and all(abs(r.end_sec - r.start_sec - r.duration_sec) < 1e-9 for r in found)
    made = spark.createDataFrame([("r", f"e_c{i}", "e", True, p, 0.3, 20.0, 0.8, 0.5) for i, p in enumerate((0.95, 0.9, 0.85))] + [("r", "f_c0", "f", True, 0.6, 0.3, 20.0, 0.8, 0.5), ("r", "g", None, False, 0.9, None, None, None, 0.5)], "recording_id string, event_id string, parent_event_id string, is_component boolean, purity_score double, component_energy_ratio double, component_snr_db double, component_compactness double, duration_sec double")
    why = {r.event_id: r.component_reason for r in discovery.gated(made).collect()}
    assert why == {"e_c0": "clusterable_component", "e_c1": "clusterable_component", "e_c2": "component_rank_exceeds_clustering_limit", "f_c0": "component_purity_below_threshold", "g": None}


def test_window_graph_pipeline(spark, folder):
    c = WindowConfig(rate=RATE, window=1.0, hop=0.5, neighbours=5, min_cluster=3, max_gap=0.5)
    win, events, clusters = window_graph.run(src.load(spark, str(folder), RATE).where("recording_id = 'a'"), c)
    assert win.count() == (12 * 2 - 2) + 2 and win.where("label >= 0").count() > 5
    rows = events.collect()
    assert rows and all(len(r.embedding) == 256 for r in rows) and [r.event_id for r in sorted(rows, key=lambda r: r.start_sec)] == [f"event_{i:06d}" for i in range(len(rows))]
    names = spark.createDataFrame([(rows[0].event_id, "Great Tit")], "event_id string, label string")
    named = window_graph.few_shot(clusters, events, names, c).collect()
    assert any(r.name == "Great Tit" and r.folder.endswith("Great_Tit") for r in named)


def test_window_events_are_refined_named_and_captioned(spark, monkeypatch):
    x = scene(40, [(t, tone(2000, 0.6)) for t in (3.2, 13.2, 23.2, 33.2)], noise=0.0001)
    docs = spark.createDataFrame([("r", RATE, bytearray(x.tobytes()))], "recording_id string, sample_rate int, samples binary")
    c = WindowConfig(rate=RATE, window=2.0, hop=1.0, neighbours=2, min_cluster=2, max_gap=0.5)
    wide = window_graph.run(docs, WindowConfig(rate=RATE, window=2.0, hop=1.0, neighbours=2, min_cluster=2, max_gap=0.5, refine=False))[1].collect()
    _, found, clusters = window_graph.run(docs, c)
    rows = sorted(found.collect(), key=lambda r: (r.start_sec, r.end_sec, r.event_id))
    assert wide and min(r.end_sec - r.start_sec for r in wide) >= 2.0 and len(rows) == len(wide)
    assert any(r.end_sec - r.start_sec < 1.0 and abs(r.start_sec - at) < 0.2 for r in rows for at in (3.2, 13.2, 23.2, 33.2))
    assert [r.event_id for r in rows] == [f"event_{i:06d}" for i in range(len(rows))]
    prompts = spark.createDataFrame([("same", [float(v) for v in rows[0].embedding]), ("other", [-float(v) for v in rows[0].embedding])], "prompt string, embedding array<double>")
    names = spark.createDataFrame([(rows[0].event_id, "Great Tit")], "event_id string, label string")
    monkeypatch.setitem(plugins.DENOISERS, "mute", lambda y, rate: y * 0)
    got = {r.label: r for r in window_graph.run(docs, c, prompts, names)[2].collect()}
    assert got[rows[0].label].caption == "same" and any(r.name == "Great Tit" for r in got.values())
    assert window_graph.windows(docs, WindowConfig(rate=RATE, window=2.0, denoiser="mute")).where("embedding is not null").count() == 0


def test_annotations_and_labels(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.csv").write_text("Starttime,Endtime,Q\n0.5,1.0,POS\n2,3,NEG\n4,3,POS\nx,5,POS\n6,7,UNK\n8,9,\n9,9.5, Great Tit \n")
    got = src.annotations(spark, str(tmp_path / "n")).collect()
    assert [(r.file_id, r.start_sec, r.label) for r in got] == [("a", 0.5, "POS"), ("a", 8.0, "event"), ("a", 9.0, "Great Tit")]
    (tmp_path / "l.json").write_text(json.dumps({"e0": "bird", "e1": "frog"}))
    assert {r.event_id: r.label for r in src.labels(spark, str(tmp_path / "l.json")).collect()} == {"e0": "bird", "e1": "frog"}
    files = spark.createDataFrame([("x/a.wav", "a"), ("x/rec_b.wav", "rec_b"), ("x/c.wav", "c")], "path string, stem string")
    notes = spark.createDataFrame([("n/a.csv", "a"), ("n/b.csv", "b")], "note_path string, note_stem string")
    assert {r.path: r.note_path for r in src.pair(files, notes).collect()} == {"x/a.wav": "n/a.csv", "x/rec_b.wav": "n/b.csv", "x/c.wav": None}


def test_service_helpers(spark, tmp_path):
    assert res.safe_name("../x y.mp3") == "x_y.mp3.wav" and res.safe_name("") == "recording.wav"
    assert res.inside(str(tmp_path), "a/b") and not res.inside(str(tmp_path), "../b")
    assert res.cleaned({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}
    assert res.assemble({1: b"b", 0: b"a"}, 2) == b"ab"
    with pytest.raises(ValueError):
        res.assemble({0: b"a", 2: b"c"})
    jobs = res.Jobs(spark, str(tmp_path / "jobs"))
    jobs.put("j", "queued")
    jobs.put("j", "done", n=3)
    assert [(r.status, json.loads(r.result)) for r in jobs.latest().collect()] == [("done", {"n": 3})]
    assert src.with_split(spark.createDataFrame([("x/Validation_Set/ME/a.wav",)], "path string")).select("split", "subset").first()[:] == ("validation", "ME")
    named = src.with_split(spark.createDataFrame([("x/Training_Set/b/HB_1.wav",), ("x/y/abc_1.wav",), ("x/y/1.wav",)], "path string")).select("split", "subset").collect()
    assert [r[:] for r in named] == [("train", "HB"), ("all", "ABC"), ("all", None)]
    assert jobs.latest().select(F.max("updated_ns")).first()[0] > 0


def test_density_hierarchy_finds_groups_and_noise():
    r = np.random.default_rng(7)
    centres = np.array([[0, 0], [6, 0], [0, 7]])
    x = np.concatenate([r.normal(c, 0.25, (25, 2)) for c in centres] + [r.uniform(-30, -20, (4, 2)) * [1, 3]])
    labels, p = k.density_clusters(x, 8, 4)
    for i in range(3):
        assert len(set(labels[25 * i : 25 * i + 25].tolist()) - {-1}) == 1 and (labels[25 * i : 25 * i + 25] >= 0).mean() > 0.8
    assert len(set(labels.tolist()) - {-1}) == 3 and (labels[75:] == -1).all() and ((p >= 0) & (p <= 1)).all()
    assert k.density_clusters(x[:4], 8, 4)[0].tolist() == [0] * 4


def test_fallback_groups():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 0.3, (12, 2)), r.normal(40, 0.3, (12, 2)), [[100.0, -100.0]]])
    assert k.near_clusters(x, 2.0, 3).tolist() == [0] * 12 + [1] * 12 + [-1]
    spread = np.array([[100.0 * i, 0.0] for i in range(20)])
    labels, p = k.fallback_clusters(spread, 5, 2)
    assert len(set(labels.tolist())) == 4 and (p == 1).all() and (np.diff(labels) != 0).sum() == 3
    assert sorted(np.bincount(k.ward_clusters(x[:24], 2)).tolist()) == [12, 12]


def test_masks_are_cleaned_and_smoothed():
    mask = np.zeros((20, 20), bool)
    mask[5:12, 5:12], mask[2, 2], mask[8, 8] = True, True, False
    clean = k.cleaned_mask(mask)
    assert not clean[2, 2] and clean.sum() > 0
    soft = k.smoothed(mask)
    assert abs(soft.max() - 1) < 1e-12 and soft.min() >= 0 and 0 < soft[4, 8] < soft[6, 6]


def test_profiles_regimes_and_adapted_settings(spark, folder):
    empty = k.profile(np.zeros(0), RATE)
    assert empty["p10"] == -120.0 and empty["stationarity"] == 1.0
    hum = scene(6, [(0.5, tone(3000, 5.0))], noise=0.001)
    p = k.profile(hum, RATE, 1024, 256)
    assert p["dynamic_range"] >= 0 and 0 <= p["active"] <= 1 and abs(p["dominant_hz"] - 3000) < 800
    assert set(p) == set(empty)
    base = DiscoveryConfig(rate=RATE)
    quiet = {"dynamic_range": 10.0, "median_tonality": 0.05, "regime": "transient_dense", "hint": None}
    c = adapted(base, quiet)
    assert (c.threshold_db, c.max_event, c.min_event, c.noise_mode, c.min_quality, c.tonality_floor, c.review_short) == (4.0, 2.0, 0.08, "exploratory", 0.25, 0.05, False)
    assert adapted(base, quiet | {"hint": "insect_sustained"}).max_event == 60.0
    assert "threshold_db: 8.0 -> 4.0" in described(base, quiet) and "nothing changes" in described(base, {"dynamic_range": 30.0, "median_tonality": 0.5, "regime": "default_sparse"})
    rows = discovery.profiles(src.load(spark, str(folder), RATE), base).collect()
    assert {r.recording_id for r in rows} == {"a", "b"} and all(r.regime in ("sustained_narrowband", "transient_dense", "low_dynamic_range", "dense_variable", "default_sparse") for r in rows)
    events, _ = discovery.run(src.load(spark, str(folder), RATE), DiscoveryConfig(rate=RATE, frame=1024, hop=256, min_cluster=2, adaptive=True))
    assert events.count() > 0 and "settings" not in events.columns


def test_sweep_settings_and_forms():
    v = variants(DiscoveryConfig())
    assert list(v) == ["baseline_current", "tight_temporal_precision", "energy_only_precision", "precision_balanced", "rare_event_guard", "clean_clusters"]
    assert (v["tight_temporal_precision"].merge_gap, v["tight_temporal_precision"].threshold_db, v["energy_only_precision"].flux, v["rare_event_guard"].threshold_db) == (0.15, 8.0, False, 7.0)
    c = from_form({"threshold_db": " 6.5 ", "adaptive": "yes", "min_cluster": "", "unknown": "x"})
    assert (c.threshold_db, c.adaptive, c.min_cluster) == (6.5, True, 10)
    with pytest.raises(ValueError, match="min_cluster"):
        from_form({"min_cluster": "many"})


def test_command_line_evaluates_tunes_and_calibrates(spark, folder, tmp_path):
    from stratalyn.__main__ import main

    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.csv").write_text("Starttime,Endtime,Q\n" + "".join(f"{t},{t + 0.4},POS\n" for t in (1, 2.5, 4, 5.5, 7, 8.5, 10)))
    own = [f"--{n}={v}" for n, v in (("rate", RATE), ("frame", 1024), ("hop", 256), ("min-cluster", 2))]
    assert main(["evaluate", str(folder), str(tmp_path / "eval"), "--annotations", str(notes), *own]) == 0
    summary = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "eval/summary.json")).collect()))
    assert set(summary["views"]) == {"raw", "parent_aware", "clusterable"} and summary["views"]["raw"]["n_gt"] == 7 and 0 < summary["final_score_100"] <= 100
    assert summary["views"]["raw"]["recall"] > 0.5 and summary["views"]["raw"]["mean_iou"] > 0.2
    matched = spark.read.parquet(str(tmp_path / "eval/matched_predictions"))
    assert matched.where("hit").count() >= 4 and {"match_iou", "match_overlap_ratio", "matched_gt_label"} <= set(matched.columns)
    assert "| clusterable |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "eval/report.md")).collect())
    assert main(["calibrate", str(tmp_path / "eval"), str(tmp_path / "cal")]) == 0
    assert {"min_duration", "min_clusterable_detection_score"} <= {r.name for r in spark.read.json(str(tmp_path / "cal/recommended_thresholds")).collect()}
    assert main(["tune", str(folder), str(tmp_path / "tune"), "--annotations", str(notes), "--most", "2", *own]) == 0
    best = json.loads(spark.read.text(str(tmp_path / "tune/best")).first().value)
    assert best["best_trial"].startswith("trial_00") and best["best_config"]["rate"] == RATE
    assert spark.read.parquet(str(tmp_path / "tune/trials")).count() == 2


def test_command_line_writes_tables_clips_and_documents(spark, folder, tmp_path):
    from stratalyn.__main__ import main

    out = tmp_path / "out"
    assert main(["discover", str(folder), str(out), "--clips", *[f"--{n}={v}" for n, v in (("rate", RATE), ("frame", 1024), ("hop", 256), ("min-cluster", 2))]]) == 0
    table = spark.read.option("header", "true").csv(str(out / "events_table"))
    assert table.columns == ["recording_id", *service.EVENT_COLUMNS] and len(service.EVENT_COLUMNS) == 64 and table.count() > 3
    clips = [r.clip_path for r in table.collect()]
    assert all((out / c).exists() and (out / c).with_suffix(".png").exists() and json.loads((out / c).with_suffix(".json").read_text())["event_id"] for c in clips)
    assert spark.read.option("header", "true").csv(str(out / "clusters_table")).columns == ["recording_id", *service.CLUSTER_COLUMNS]
    assert spark.read.parquet(str(out / "representatives")).where("folder like '%/_representatives'").count() >= 1
    doc = json.loads(spark.read.json(str(out / "job")).where("recording_id = 'a'").first().document)
    pages = {r.recording_id: r.html for r in spark.read.json(str(out / "review")).collect()}
    assert pages["a"].count("<tr>") > 1 and "| original |" in spark.read.text(str(out / "report")).agg(F.array_join(F.collect_list("value"), "\n")).first()[0]
    assert json.loads(spark.read.json(str(out / "run")).first().config)["rate"] == RATE
    assert doc["clusters"] and all(c["events"] and c["representatives"] for c in doc["clusters"])
    schema = "recording_id string, event_id string"
    assert src.read_if_present(spark, str(out / "nothing"), schema).count() == 0 and src.read_if_present(spark, str(out / "events_table"), schema).count() == table.count()
    notes = src.annotation_index(spark, str(out))
    assert notes.columns == ["note_path", "note_stem"]


def test_functions_for_sql(spark):
    from stratalyn.functions import registry

    assert "interval_iou" in registry.register(spark)
    row = spark.sql("select interval_iou(0, 2, 1, 3) a, interval_cover(0, 2, 1, 3) b, smooth_ramp(0, 1, 0.5) c, name_slug(' Great  Tit ', 'x') d, name_slug('--', 'x') e").first()
    assert abs(row.a - 1 / 3) < 1e-12 and (row.b, row.c, row.d, row.e) == (0.5, 0.5, "Great_Tit", "x")
    assert [r[:] for r in spark.sql("select * from interval_chunks(0D, 10D, 4D, 1D)").collect()] == [(0, 0.0, 4.0), (1, 2.0, 6.0), (2, 4.0, 8.0), (3, 6.0, 10.0)]
