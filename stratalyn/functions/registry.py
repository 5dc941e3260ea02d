"""Functions for SQL: intervals and scores as native SQL functions, the chunks of a long interval as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SIGNATURE = "(s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE) RETURNS DOUBLE"
SHARED = "greatest(0D, least(e1, e2) - greatest(s1, s2))"
#: Names and bodies; Catalyst inlines them, so they cost what the expression costs.
FUNCTIONS = {
    "interval_iou": f"{SIGNATURE} RETURN CASE WHEN greatest(e1, e2) > least(s1, s2) THEN {SHARED} / (greatest(e1, e2) - least(s1, s2)) ELSE 0D END",
    "interval_cover": f"{SIGNATURE} RETURN CASE WHEN e2 > s2 THEN {SHARED} / (e2 - s2) ELSE 0D END",
    "smooth_ramp": "(low DOUBLE, high DOUBLE, x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN high <= low THEN CASE WHEN x >= high THEN 1D ELSE 0D END ELSE pow(least(greatest((x - low) / (high - low), 0D), 1D), 2) * (3 - 2 * least(greatest((x - low) / (high - low), 0D), 1D)) END",
    "name_slug": "(name STRING, other STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(name, '[^\\\\p{L}\\\\p{N}]+', '_'), '^_+|_+$', ''), ''), other)",
}


@udtf(returnType="chunk int, start_sec double, end_sec double")
class IntervalChunks:
    """Half-overlapping chunks of at most ``longest`` seconds; a last chunk under ``shortest`` goes."""

    def eval(self, start: float, end: float, longest: float, shortest: float) -> Iterator[tuple[int, float, float]]:
        at, i = start, 0
        while True:
            stop = min(end, at + longest)
            if stop - at >= shortest:
                yield i, at, stop
            if stop >= end:
                return
            at, i = at + longest / 2, i + 1


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("interval_chunks", IntervalChunks)
    return [*FUNCTIONS, "interval_chunks"]
