"""What a service over stored results answers: events with their metadata, clusters with their events, one document a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalyn.operators.routing import by_bucket

#: The columns of the event table, in order.
EVENT_COLUMNS = (
    "event_id", "start_sec", "end_sec", "duration_sec", "cluster_id", "is_noise", "cluster_probability", "rms_db", "peak_db", "spectral_centroid", "clip_path", "spectrogram_path", "parent_event_id", "component_id", "is_component",
    "is_overlapping", "is_mixed", "n_components", "polyphony_score", "purity_score", "source_type", "context_clip_path", "is_low_confidence_noise", "snr_db", "noise_floor_db", "spectral_flatness", "tonality_score", "bandwidth_hz",
    "peak_band_snr_db", "quality_score", "eventness_score", "temporal_contrast_db", "active_ratio", "is_low_confidence_event", "selection_score", "is_pruned_candidate", "candidate_route_reason", "is_short_review_event",
    "local_snr_score", "spectral_structure_score", "duration_confidence", "embedding_stability_score", "broadband_noise_penalty", "overlap_penalty", "edge_case_penalty", "clusterability_score", "is_ambiguous_review",
    "acoustic_prefamily", "cluster_stability_score", "representative_score", "detection_score", "event_snr_db", "active_band_fraction", "spectral_flux_score", "stationarity_score", "component_energy_ratio", "component_snr_db",
    "component_compactness", "component_quality_score", "is_component_review", "component_rank_in_parent", "clusterable", "routing_reason", "is_low_detection_confidence",
)
#: The columns of the cluster table, in order.
CLUSTER_COLUMNS = ("cluster_id", "size", "folder_name", "mean_probability", "representative_event_ids", "mean_purity_score", "n_component_events", "n_original_events", "mean_clusterability_score", "mean_stability_score", "acoustic_prefamily")
#: Names of our columns that the tables call otherwise.
RENAMED = {
    "acoustic_prefamily": "family", "spectral_structure_score": "structure_score", "embedding_stability_score": "embedding_stability", "broadband_noise_penalty": "broadband_penalty", "edge_case_penalty": "edge_penalty",
    "cluster_stability_score": "cluster_probability", "event_snr_db": "snr_db", "component_rank_in_parent": "component_rank", "routing_reason": "route_reason", "candidate_route_reason": "route_reason", "source_type": "route",
    "mean_purity_score": "mean_purity", "mean_clusterability_score": "mean_clusterability", "mean_stability_score": "mean_stability",
}


def three_decimals(x: Column) -> Column:
    """``x`` with three decimals as C and Python print it: its exact value decides, exact halves go to the even digit.

    Spark's ``%.3f`` rounds the shortest decimal text of a number instead, and halves of it up. The fraction is split into
    a part of 26 bits and a rest, so that a thousand times either is exact. From 2^63 on Spark's own digits are used.
    """
    a = F.abs(x)
    f = a - F.floor(a)
    high = F.floor(f * 2.0**26) / 2.0**26
    down = F.floor(high * 1000)
    over = (high * 1000 - down - 0.5) + (f - high) * 1000  # more or less than half a thousandth; the sign is exact
    n = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    text = F.concat((F.floor(a) + F.when(n == 1000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    # null stays null
    return F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a >= 2.0**63, F.format_string("%.3f", x)).otherwise(F.concat(sign, text))


def file_stem() -> Column:
    """File name of an event without ending: its id, or parent and component, and its times with three decimals."""
    col = lambda c: F.col(c).cast("string")
    name = F.when(F.col("is_component") & F.col("parent_event_id").isNotNull() & F.col("component_id").isNotNull(), F.concat(col("parent_event_id"), F.lit("_component_"), col("component_id"))).otherwise(col("event_id"))
    return F.concat(name, F.lit("__"), three_decimals(F.col("start_sec").cast("double")), F.lit("-"), three_decimals(F.col("end_sec").cast("double")))


def event_table(events: DataFrame) -> DataFrame:
    """The event table: recording_id and its 64 columns, null where a run has no such value."""
    route, have = F.col("route"), set(events.columns)
    flags = {
        "is_noise": F.coalesce(F.col("cluster_id"), F.lit(-1)) < 0, "is_low_confidence_noise": route == "low_confidence_noise", "is_low_confidence_event": route == "low_confidence_noise", "is_short_review_event": route == "short_review",
        "is_ambiguous_review": route == "ambiguous_review", "is_component_review": route == "component_review", "is_low_detection_confidence": route == "low_detection_confidence",
        "is_pruned_candidate": F.coalesce(F.col("route_reason").rlike("component_limit|temporal_nms"), F.lit(False)), "component_id": F.regexp_extract("event_id", r"_c([0-9]+)$", 1).try_cast("int"),
    }
    value = lambda c: flags[c] if c in flags else F.col(c) if c in have else F.col(RENAMED[c]) if RENAMED.get(c) in have else F.lit(None).cast("string")
    return events.select("recording_id", *[value(c).alias(c) for c in EVENT_COLUMNS])


def cluster_table(clusters: DataFrame) -> DataFrame:
    """The cluster table: recording_id and its 11 columns."""
    have = set(clusters.columns)
    special = {
        "folder_name": F.format_string("cluster_%03d_size_%03d", F.col("cluster_id"), F.col("size")), "representative_event_ids": F.array_join("representative_event_ids", ","),
    }
    value = lambda c: special[c] if c in special else F.col(c) if c in have else F.col(RENAMED[c]) if RENAMED.get(c) in have else F.lit(None).cast("string")
    return clusters.select("recording_id", *[value(c).alias(c) for c in CLUSTER_COLUMNS])


def described(events: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Events with ``metadata``, the row of ``metadata`` of the same keys as a struct; null where there is none."""
    fields = [c for c in metadata.columns if c not in keys]
    one = metadata.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("metadata"))
    return events.join(one, keys, "left")


def with_events(clusters: DataFrame, events: DataFrame, key: str = "recording_id") -> DataFrame:
    """Clusters with ``events``, theirs in the order of ids, and ``representatives``, those named in ``representative_event_ids``, a list or a text with commas."""
    keys = [key, "cluster_id"]
    row = F.struct("event_id", *[c for c in events.columns if c not in (*keys, "event_id")])
    own = events.where("cluster_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("events"))
    both = clusters.join(own, keys, "left").withColumn("events", F.coalesce("events", F.array().cast(own.schema["events"].dataType)))
    listed = clusters.schema["representative_event_ids"].dataType.typeName() == "array"
    names = F.col("representative_event_ids").cast("array<string>") if listed else F.split("representative_event_ids", ",")
    return both.withColumn("representatives", F.filter("events", lambda e: F.array_contains(names, e["event_id"].cast("string"))))


def job_document(events: DataFrame, clusters: DataFrame, url: str = "") -> DataFrame:
    """(recording_id, document): clusters with their events, review folders and links as one JSON text."""
    link = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{url}/"), F.col(c)))
    linked = events.withColumns({f"{c}_url": link(c) for c in ("clip_path", "spectrogram_path", "context_clip_path") if c in events.columns})
    nested = with_events(clusters, linked).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", *[c for c in (*clusters.columns, "events", "representatives") if c not in ("recording_id", "cluster_id")]))).alias("clusters"))
    folders = by_bucket(events, ["recording_id"]).groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("route", "event_ids"))).alias("review_folders"))
    all_of = linked.groupBy("recording_id").agg(F.count("*").alias("n_events"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    doc = F.to_json(F.struct("recording_id", "created_at", "n_events", "clusters", "review_folders"))
    return all_of.join(nested, "recording_id", "left").join(folders, "recording_id", "left").select("recording_id", doc.alias("document"))
