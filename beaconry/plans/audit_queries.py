"""Registered queries for versioned datasets, contracts and the audit."""

from pyspark.sql import functions as F

from beaconry.operators import audit as A
from beaconry.operators import catalog as C
from beaconry.operators import contracts as V
from beaconry.operators import generations as N
from beaconry.plans.action_queries import both_items
from beaconry.plans.catalog_queries import stored_catalog as catalog
from beaconry.plans.common import Tables, written

HASHED = ["row_key", "o_custkey", "o_orderstatus", "cents"]


def manifest(t: Tables):
    return t.once("_manifest", lambda: N.generation_manifest(t.generation_rows, HASHED, "md5"))


def declared_manifest(t: Tables):
    """Recorded manifest with a changed hash, missing rows and extra rows here and there."""
    no = F.substring("generation_id", 2, 9).cast("int")
    kept = manifest(t).filter(~((no % 7 == 2) & (F.col("artifact") == "signals")))
    changed = kept.withColumn("fingerprint", F.when((no % 5 == 1) & (F.col("artifact") == "catalog"), F.concat("fingerprint", F.lit("9"))).otherwise(F.col("fingerprint")))
    extra = kept.filter((no % 6 == 3) & (F.col("artifact") == "snapshot")).withColumn("artifact", F.lit("notes"))
    return changed.unionByName(extra)


def manifest_audits(t: Tables):
    no = F.substring("generation_id", 2, 9).cast("int")
    actual = manifest(t).select("generation_id").distinct().withColumn("error_count", F.lit(0)).withColumn("warning_count", no % 3)
    declared = actual.withColumn("warning_count", F.when(no % 8 == 0, 9).otherwise(F.col("warning_count"))).filter(no % 11 != 4)
    return declared, actual


def verified(t: Tables):
    return N.verified_generations(N.verify_manifest(declared_manifest(t), manifest(t)), *manifest_audits(t))


def dataset_diff(t: Tables):
    """Each quarter's inventory against the quarter before."""
    new = t.inventory
    old = t.inventory.withColumn("qno", F.col("qno") + 1)
    return N.dataset_diff(old, new, ["qno", "o_custkey"], "cents")


def snapshot_issues(t: Tables):
    return V.contract_issues(t.faulty_snapshot, "snapshot", "capture_id", F.col("ord"), V.SNAPSHOT_RULES)


def signal_issues(t: Tables):
    return V.contract_issues(t.faulty_signals, "signals", "run_id", F.col("ord"), V.SIGNAL_RULES)


def counts(t: Tables):
    return A.audit_counts(t.audit_headers, t.audit_snapshot, t.audit_catalog, t.audit_signals, t.audit_queue)


def uniqueness(t: Tables):
    return A.audit_uniqueness(t.audit_snapshot, t.audit_catalog, t.audit_artifacts, t.audit_profiles, t.audit_signals, t.audit_sources, t.audit_queue)


def references(t: Tables):
    return A.audit_references(t.audit_headers, t.audit_snapshot, t.audit_catalog, t.audit_rules, t.audit_artifacts)


def presence(t: Tables):
    return A.audit_presence(t.audit_headers, t.audit_inventory, ["snapshot", "catalog", "signals", "queue"])


def query_health(t: Tables):
    return A.audit_query_health(t.audit_headers, t.audit_rules, t.audit_status)


def sources(t: Tables):
    return A.audit_sources(t.audit_headers, t.audit_sources)


def times(t: Tables):
    """Time checks under the ids of the captures that the headers belong to."""
    ids = t.audit_headers.select("generation_id", F.concat(F.lit("g"), "gno").alias("header_id"))
    found = A.audit_times(t.generation_headers).withColumnRenamed("generation_id", "header_id")
    return found.join(ids, "header_id").drop("header_id")


def every_issue(t: Tables):
    """The rows of all fifteen check groups; those that rebuild other results are written first, each as a job of its own."""
    rebuilt = [t.once(f"_issues_{f.__name__}", lambda f=f: f(t)) for f in (heat, queue_rebuild, catalog_rebuild, growth)]
    return A.union(presence(t), A.audit_shape(t.intake_documents, t.intake_rows), times(t), counts(t), uniqueness(t), references(t), query_health(t),
                   A.audit_tracks(t.audit_headers, t.audit_catalog),
                   A.audit_urls_scores(t.audit_headers, t.audit_catalog, t.audit_signals, t.audit_sources), sources(t),
                   A.audit_analysis_failures(t.audit_headers, t.audit_failures), *rebuilt)


def report(t: Tables):
    written = t.generation_headers.select(F.col("generation_id").alias("header_id"), "snapshot_at", "catalog_at")
    heads = (t.audit_headers.select("generation_id", F.concat(F.lit("g"), "gno").alias("header_id")).join(written, "header_id", "left").drop("header_id")
             .join(declared_previous(t), "generation_id", "left"))
    return A.audit_report(heads, t.audit_snapshot, t.audit_catalog, t.audit_signals, t.audit_sources, t.audit_queue, t.audit_status, t.audit_failures,
                          every_issue(t))


def _no(col="capture_id"):
    return F.substring(col, 2, 4).try_cast("int") * 4 + F.substring(col, 7, 1).try_cast("int") - 1


def recorded_catalog(t: Tables):
    """The catalog job's own rows as a recorded generation, with some fields altered."""
    no = _no()
    at = F.col("position")
    rows = catalog(t).withColumn("generation_id", F.col("capture_id"))
    return (rows.withColumn("obs_count", F.when((no % 6 == 1) & (at == 2), F.col("obs_count") + 1).otherwise(F.col("obs_count")))
            .withColumn("long_term_evidence", F.when((no % 7 == 2) & (at == 3), None).otherwise(F.col("long_term_evidence")))
            .withColumn("attention", F.when((no % 8 == 3) & (at == 4), F.col("attention") + 1).otherwise(F.col("attention")))
            .withColumn("growth_value", F.when((no % 9 == 4) & (at == 5), F.col("growth_value") + 1).otherwise(F.col("growth_value")))
            .withColumn("growth_kind", F.when((no % 10 == 5) & (at == 6), "velocity_proxy").otherwise(F.col("growth_kind")))
            .withColumn("analysis_state", F.when((no % 5 == 1) & (at == 1), F.when(F.col("analysis_state") == "deep", "static").otherwise("deep"))
                        .otherwise(F.col("analysis_state"))))


def heat_inputs(t: Tables):
    rows = recorded_catalog(t)
    no = _no("generation_id")
    # Growth follows one repository at a time, so the captures of the recorded ones are enough.
    facts = t.audit_facts.withColumn("_l", F.lower("repo")).join(rows.select(F.lower("repo").alias("_l")).distinct(), "_l", "left_semi").drop("_l")
    truth = C.with_growth(facts, t.captures).select(
        F.col("capture_id").alias("generation_id"), "repo", "obs_count", "obs_window", C.persistence_verified(F.col("obs_count"), F.col("obs_window")).alias("persistent"))
    heads = rows.groupBy("generation_id").agg(F.max("obs_window").alias("w"), F.count_if(F.col("verified")).alias("v")).select(
        "generation_id", (F.col("w") + F.when(no % 11 == 1, 1).otherwise(0)).alias("snapshot_count"), F.when(no % 11 == 2, 31).otherwise(30).alias("maximum_snapshots"),
        F.when(no % 11 == 3, 8).otherwise(7).alias("minimum_persistence"), (F.col("v") + F.when(no % 11 == 4, 1).otherwise(0)).alias("verified_long_term"))
    return heads, rows, truth


def heat(t: Tables):
    return A.audit_heat(*heat_inputs(t))


def queue_rebuild_inputs(t: Tables):
    projects, signals = (t.once(f"_queue{i}", lambda rows=rows: rows) for i, rows in enumerate(both_items(t)))
    cols = ["id", "kind", "priority", "reason", "repository", "url"]
    both = projects.unionByName(signals, allowMissingColumns=True).withColumn("generation_id", F.col("queue_id"))
    rebuilt = both.select("generation_id", "completed", *cols)
    no = _no("generation_id")
    recorded = (rebuilt.filter("NOT completed").filter(~((no % 9 == 1) & (F.col("priority") == 100)))
                .withColumn("reason", F.when((no % 9 == 2) & (F.col("priority") == 96), "altered").otherwise(F.col("reason")))
                .withColumn("kind", F.when((no % 9 == 3) & (F.col("priority") == 92), "idea").otherwise(F.col("kind"))))
    rows = recorded_catalog(t)
    heads = rebuilt.groupBy("generation_id").agg(
        F.count_if(F.col("completed") & (F.col("kind") == "project")).alias("p"), F.count_if(F.col("completed") & (F.col("kind") == "signal")).alias("s"))
    pending = rows.filter("position <= 5").groupBy("generation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("analysis_state") != "deep", F.struct("position", "repo")))), lambda x: x["repo"]), "|").alias("pd"))
    heads = heads.join(pending, "generation_id", "left").na.fill("", ["pd"]).select(
        "generation_id", (F.col("p") + F.when(no % 8 == 1, 1).otherwise(0)).alias("completed_project_count"),
        (F.col("s") + F.when(no % 8 == 2, 1).otherwise(0)).alias("completed_signal_count"),
        F.when(no % 8 == 3, F.concat("pd", F.lit("|x"))).otherwise(F.col("pd")).alias("pending_deep"))
    return heads, recorded, rebuilt, rows, cols


def queue_rebuild(t: Tables):
    return A.audit_queue_rebuild(*queue_rebuild_inputs(t))


REBUILT = ["repo", "attention", "endurance", "readiness", "completeness", "recommendation", "growth_kind", "growth_value", "obs_count",
           "long_term_evidence", "analysis_state"]


def catalog_rebuild_inputs(t: Tables):
    no = _no("generation_id")
    heads = t.captures.select(F.col("capture_id").alias("generation_id")).withColumn("score_model", F.when(no % 12 == 1, "legacy-v1").otherwise("evidence-v2"))
    return heads, recorded_catalog(t), catalog(t).withColumn("generation_id", F.col("capture_id")), REBUILT


def catalog_rebuild(t: Tables):
    return A.audit_catalog_rebuild(*catalog_rebuild_inputs(t))


def declared_previous(t: Tables):
    """The time of the capture before as recorded, wrong or absent here and there."""
    previous = C.previous_capture(t.captures).select("capture_id", "previous_ts")
    no = _no("generation_id")
    at = F.date_format("previous_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return previous.withColumn("generation_id", F.col("capture_id")).select(
        "generation_id", F.when(no % 11 == 6, "1980-01-01T00:00:00Z").when(no % 13 == 7, None).otherwise(at).alias("previous_at"))


def growth_inputs(t: Tables):
    snapshot = t.audit_facts.withColumn("generation_id", F.col("capture_id"))
    return declared_previous(t), recorded_catalog(t).drop("capture_id"), snapshot, t.audit_facts


def growth(t: Tables):
    return A.audit_growth(*growth_inputs(t))


QUERIES = {
    "generation_manifest": manifest,
    "verify_manifest": lambda t: N.verify_manifest(declared_manifest(t), manifest(t)),
    "verified_generations": verified,
    "refresh_baseline_check": lambda t: N.refresh_baseline_check(t.baseline_pairs, t.baseline_rows),
    "derive_baseline_check": lambda t: N.derive_baseline_check(t.baseline_pairs, t.baseline_rows),
    "commit_coherence": lambda t: N.commit_coherence(t.generation_headers),
    "publication_lineage": lambda t: N.publication_lineage(t.generation_log, written),
    "dataset_diff": dataset_diff,
    "contract_issues": snapshot_issues,
    "signal_contract_issues": signal_issues,
    "bounded_contract_report": lambda t: V.bounded_report(snapshot_issues(t).unionByName(signal_issues(t))),
    "identity_contract_issues": lambda t: V.identity_contract_issues(t.artifact_files),
    "capture_required_fields": lambda t: V.capture_required_fields(t.capture_headers),
    "manifest_contract": lambda t: V.manifest_contract(t.manifest_artifacts, t.manifest_hashes, t.manifests),
    "audit_presence": presence,
    "audit_shape": lambda t: A.audit_shape(t.intake_documents, t.intake_rows),
    "audit_times": lambda t: A.audit_times(t.generation_headers),
    "audit_counts": counts,
    "audit_uniqueness": uniqueness,
    "audit_references": references,
    "audit_query_health": query_health,
    "audit_tracks": lambda t: A.audit_tracks(t.audit_headers, t.audit_catalog),
    "audit_heat": heat,
    "audit_urls_scores": lambda t: A.audit_urls_scores(t.audit_headers, t.audit_catalog, t.audit_signals, t.audit_sources),
    "audit_sources": sources,
    "audit_queue_rebuild": queue_rebuild,
    "audit_catalog_rebuild": catalog_rebuild,
    "audit_growth": growth,
    "audit_analysis_failures": lambda t: A.audit_analysis_failures(t.audit_headers, t.audit_failures),
    "audit_issues": every_issue,
    "audit_report": report,
    "run_status": lambda t: A.run_status(report(t)),
}
