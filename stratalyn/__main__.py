"""python -m stratalyn discover|windows|evaluate|tune|calibrate ...: both pipelines and their evaluation."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging

from pyspark.sql import SparkSession


def _truth(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def _options(p: argparse.ArgumentParser, kind) -> None:
    for f in dataclasses.fields(kind):
        p.add_argument(f"--{f.name.replace('_', '-')}", type=_truth if isinstance(f.default, bool) else type(f.default), default=f.default)


def _config(kind, args):
    return kind(**{f.name: getattr(args, f.name) for f in dataclasses.fields(kind)})


def _parser() -> argparse.ArgumentParser:
    from stratalyn.config import DiscoveryConfig, WindowConfig

    parser = argparse.ArgumentParser(prog="stratalyn", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, kind in (("discover", DiscoveryConfig), ("windows", WindowConfig), ("evaluate", DiscoveryConfig), ("tune", DiscoveryConfig), ("calibrate", None)):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--verbose", action="store_true")
        if kind:
            _options(p, kind)
    sub.choices["discover"].add_argument("--clips", action="store_true", help="write a clip, a picture and a JSON text for every event")
    for name in ("evaluate", "tune"):
        sub.choices[name].add_argument("--annotations", required=True)
    sub.choices["tune"].add_argument("--budget", choices=("quick", "balanced"), default="quick")
    sub.choices["tune"].add_argument("--most", type=int)
    sub.choices["calibrate"].add_argument("--least-recall", type=float, default=0.85)
    return parser


def main(argv: list[str] | None = None) -> int:
    from stratalyn.config import DiscoveryConfig, WindowConfig, fingerprint
    from stratalyn.plans import discovery, window_graph
    from stratalyn.plans import evaluation as ev
    from stratalyn.plans.session import shared_dir
    from stratalyn.sources import recordings, results, service

    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("stratalyn").getOrCreate()
    shared_dir(spark)
    if args.command == "calibrate":
        swept, chosen = ev.calibrate(spark.read.parquet(f"{args.input}/matched_predictions"), args.least_recall)
        swept.write.mode("overwrite").option("header", "true").csv(f"{args.output}/routing_calibration_results")
        chosen.write.mode("overwrite").json(f"{args.output}/recommended_thresholds")
        return 0
    if args.command == "windows":
        c = _config(WindowConfig, args)
        win, events, clusters = window_graph.run(recordings.load(spark, args.input, c.rate), c)
        for name, df in (("windows", win), ("events", events), ("clusters", clusters)):
            df.write.mode("overwrite").parquet(f"{args.output}/{name}")
        return 0
    base = _config(DiscoveryConfig, args)
    loaded = recordings.load(spark, args.input, base.rate)
    if args.command == "discover":
        events, clusters = discovery.run(loaded, base)
        if args.clips:
            events = results.write_clips(loaded, events, args.output)
        results.write_events(events, args.output)
        clusters.write.mode("overwrite").parquet(f"{args.output}/clusters")
        for name, df in (("events_table", service.event_table(events)), ("clusters_table", service.cluster_table(clusters))):
            results.flat(df).write.mode("overwrite").option("header", "true").csv(f"{args.output}/{name}")
        results.representatives(events, clusters).write.mode("overwrite").parquet(f"{args.output}/representatives")
        results.metadata(events).write.mode("overwrite").parquet(f"{args.output}/metadata")
        service.job_document(events, clusters).write.mode("overwrite").json(f"{args.output}/job")
        results.review_pages(events).write.mode("overwrite").json(f"{args.output}/review")
        totals = [r.asDict() for r in events.groupBy("route").count().orderBy("route").collect()]  # one row a bucket
        spark.createDataFrame([(results.report(totals),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/report")
        results.run_metadata(events, fingerprint(base), dataclasses.asdict(base)).write.mode("overwrite").json(f"{args.output}/run")
        return 0
    gt = ev.truth(recordings.annotations(spark, args.annotations)).checkpoint()
    if args.command == "evaluate":
        events, _ = discovery.run(loaded, base)
        ev.write(args.output, *ev.evaluate(events, gt))
        return 0
    best = ev.tune(spark, loaded, gt, args.output, base, args.budget, args.most)
    spark.createDataFrame([(json.dumps(results.cleaned(best)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/best")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
