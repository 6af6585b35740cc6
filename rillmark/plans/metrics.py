"""Counters and gauges over what other queries give, in long form: (name, labels, value). A row of a list below is a query, its labels,
and its metrics; an expression reads alike in Spark and in DuckDB, while the query and its SQL are made apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.plans import catalog, control, queries as base, records, storage, waiting

_SOURCES = [base, control, records, storage, catalog, waiting]
_PART = ["stream", "part"]

DELIVERY = [
    ("dlv_expiry", ["outcome"], {"lease_outcomes_total": "count(*)", "redeliveries_total": "count_if(attempt_after > 1)", "lease_attempt_max": "max(attempt_after)"}),
    ("dlv_scheduled_due", [], {"scheduled_due_deliveries": "count(*)", "scheduled_due_oldest_ms": "min(at_ms)"}),
    ("dlv_dead_admin", ["consumer"], {"dead_letter_records": "sum(n)", "dead_letter_oldest": "min(oldest)"}),
    ("dlv_nack", ["consumer"], {"nacks_total": "count(*)", "nacks_refused_total": "count_if(deadline_ms IS NULL)"}),
    ("dlv_waiting_fetch", ["consumer"], {"pull_waits_total": "count_if(outcome IN ('woken', 'timed_out'))", "pull_waits_timed_out_total": "count_if(outcome = 'timed_out')", "pull_waits_refused_total": "count_if(outcome IN ('connection_waits', 'consumer_full', 'wait_too_long'))"}),
    ("cur_ack_window", ["outcome"], {"acknowledgements_total": "count(*)", "committed_offset_max": "max(committed)"}),
    ("ord_credit", [], {"credited_deliveries_total": "count(connection)", "blocked_deliveries_total": "count(*) - count(connection)"}),
    ("grp_moved", ["grp"], {"group_moved_partitions": "count(*)", "group_receiving_members": "count(DISTINCT member)"}),
    ("grp_generations", ["group_id"], {"group_generation": "max(generation)", "group_events_total": "count(*)"}),
    ("vw_watch_status", [], {"view_watchers": "count(*)", "view_watchers_expired": "count_if(expired)"}),
]

STORAGE = [
    ("bat_ingress", _PART, {"ingress_records_total": "count(*)", "ingress_batches_total": "count(DISTINCT batch)"}),
    ("bat_shared_commits", _PART, {"commit_flushes_total": "count(*)", "commit_waiters_total": "sum(waiters)", "commit_members_max": "max(waiters)"}),
    ("snk_queue", _PART, {"connector_records_total": "count(batch)", "connector_batches_total": "count(DISTINCT batch)", "connector_refused_total": "count_if(batch IS NULL)"}),
    ("cmp_superseded", _PART, {"compaction_candidates": "sum(superseded)", "compactions_total": "sum(compactions)"}),
    ("cmp_partition_counts", _PART, {"compacted_partitions": "count(*)"}),
    ("vw_positions", _PART, {"view_position": "max(position)", "view_entries": "sum(entries)"}),
    ("wal_cleanup", [], {"wal_removed_records": "count(*)", "wal_removed_newest": "max(seq)"}),
    ("snk_orphans", [], {"orphan_objects": "count(*)", "orphan_bytes": "sum(bytes)"}),
    ("idm_dedup", ["epoch"], {"dedup_entries": "sum(n)"}),
    ("agg_producers", [], {"producer_sessions": "count(DISTINCT producer)", "producer_entries": "sum(entries)", "producer_epoch_max": "max(epoch)"}),
]

CONTROL = [
    ("aud_status", ["tenant"], {"audit_records_total": "sum(records)", "audit_bytes_total": "sum(bytes)", "audit_oldest_retained": "min(oldest)", "audit_newest_retained": "max(newest)"}),
    ("qta_reserve", ["tenant"], {"quota_requests_total": "count(*)", "quota_rejections_total": "count(rejected_by)"}),
    ("qta_ledger", ["tenant"], {f"tenant_{k}": f"max_by(used_{k}, seq)" for k in ("connections", "memory_bytes", "disk_bytes", "tasks", "background_tasks")}),
    ("qta_work", ["class"], {"work_active_max": "max(concurrency)", "work_records_max": "max(records)", "work_rejections_total": "count_if(NOT ok)"}),
    ("rep_registrations", ["broker"], {"registrations_total": "count_if(outcome = 'accepted')", "registrations_refused_total": "count_if(outcome <> 'accepted')", "fenced_sessions_total": "count(CASE WHEN fenced THEN 1 END)", "metadata_updates_total": "coalesce(sum(updates), 0)", "snapshot_fallbacks_total": "count(CASE WHEN snapshot THEN 1 END)"}),
    ("rep_metadata", _PART, {"control_commands_total": "count_if(ok)", "control_noops_total": "count_if(NOT ok)", "leader_epoch": "max(epoch)", "committed_next_offset": "max(next_offset)"}),
    ("rep_policies", ["scope"], {"policy_generation": "max(generation)", "policy_refusals_total": "count_if(NOT ok)"}),
    ("rep_roles", ["region"], {"region_changes_total": "count_if(ok)", "region_token": "max(token)"}),
    ("plc_phases", ["phase"], {"reassignment_steps_total": "count_if(ok)"}),
    ("sch_register", [], {"schema_versions": "count(version)", "schema_rejections_total": "count(*) - count(version)", "schema_subjects": "count(DISTINCT subject)"}),
    ("udf_pipeline", ["decision"], {"middleware_messages_total": "count(*)", "middleware_emitted_total": "sum(emitted)", "middleware_generation": "max(generation)"}),
    ("jn_publish_allowed", ["allowed"], {"publishes_judged_total": "sum(n)"}),
]


def _long(df: DataFrame, labels: list[str], metrics: dict[str, str]) -> DataFrame:
    text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels])
    rows = df.groupBy(*labels).agg(*[F.expr(e).cast("double").alias(m) for m, e in metrics.items()])
    return rows.select(text.alias("labels"), *metrics).unpivot(["labels"], list(metrics), "name", "value").select("name", "labels", "value")


def exposed(s, d, parts: list) -> DataFrame:
    made = {k: f for m in _SOURCES for k, f in m.queries().items()}
    return reduce(DataFrame.unionByName, (_long(made[q](s, d), labels, metrics) for q, labels, metrics in parts))


def _sql(parts: list) -> str:
    said = {k: f for m in _SOURCES for k, f in m.oracle_sql().items()}
    one = """SELECT unnest([{names}]) AS name, labels, unnest([{columns}]) AS value FROM (SELECT {text} AS labels, {values} FROM ({sql}){group})"""
    return " UNION ALL ".join(
        one.format(
            names=", ".join(f"'{m}'" for m in metrics), columns=", ".join(metrics), values=", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in metrics.items()), sql=said[q],
            text=" || ',' || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '')" for c in labels) or "''", group=" GROUP BY " + ", ".join(labels) if labels else "")
        for q, labels, metrics in parts
    )


def agg_delivery_metrics(s, d):
    """Leases, refusals, waits, acknowledgements, credit, groups and watchers."""
    return exposed(s, d, DELIVERY)


def agg_storage_metrics(s, d):
    """Batches, flushes, connectors, compaction, views, clean-up and producers."""
    return exposed(s, d, STORAGE)


def agg_control_metrics(s, d):
    """Audit, quotas, work classes, registrations, commands, policies, regions, moves, schemas and middleware."""
    return exposed(s, d, CONTROL)


ALL = {"agg_delivery_metrics": (agg_delivery_metrics, _sql(DELIVERY)), "agg_storage_metrics": (agg_storage_metrics, _sql(STORAGE)), "agg_control_metrics": (agg_control_metrics, _sql(CONTROL))}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items()}
