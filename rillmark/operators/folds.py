"""Ordered folds: what a row does depends on what the rows before it of the same key did.

Rows are hashed by key, sorted within each task and streamed through Arrow batches; a task holds one key's
state and one batch, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """``step(state, row)`` for each row of a key in order; its results have ``schema``. A key starts with an empty state."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, state = object(), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (k := tuple(row[c] for c in keys)) != key:
                    key, state = k, {}
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: The order in which a reservation's dimensions are tried.
DIMENSIONS = ("connections", "memory_bytes", "disk_bytes", "tasks", "background_tasks")


def reservations(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(tenant, seq, rejected_by): a request is taken whole, or rejected by the first dimension it exceeds and takes nothing."""

    def step(used: dict, row: dict) -> dict:
        over = next((d for d in DIMENSIONS if used.get(d, 0) + row[d] > limits[d]), None)
        if over is None:
            used.update({d: used.get(d, 0) + row[d] for d in DIMENSIONS})
        return {"tenant": row["tenant"], "seq": row["seq"], "rejected_by": over}

    return ordered_fold(requests, ["tenant"], ["seq"], step, "tenant string, seq long, rejected_by string")


def shipped(chunks: DataFrame, fencing_token: int) -> DataFrame:
    """(stream, part, seq, outcome) of replicated chunks in arrival order.

    Outcomes: applied; stale (ends before the last one's end) and duplicate change nothing; fenced, invalid,
    conflict (same end, other checksum) and gap are errors.
    """

    def step(last: dict, row: dict) -> dict:
        if row["token"] != fencing_token:
            outcome = "fenced"
        elif row["first_off"] > row["last_off"]:
            outcome = "invalid"
        elif last and row["last_off"] < last["off"]:
            outcome = "stale"
        elif last and row["last_off"] == last["off"]:
            outcome = "duplicate" if row["checksum"] == last["checksum"] else "conflict"
        elif last and row["first_off"] != last["off"] + 1:
            outcome = "gap"
        else:
            outcome = "applied"
            last.update(off=row["last_off"], checksum=row["checksum"])
        return {"stream": row["stream"], "part": row["part"], "seq": row["seq"], "outcome": outcome}

    return ordered_fold(chunks, ["stream", "part"], ["seq"], step, "stream string, part int, seq long, outcome string")


def group_generations(events: DataFrame, timeout_ms: int) -> DataFrame:
    """(group_id, seq, outcome, generation, members) after each join, leave or heartbeat; silent members go first.

    A leave or heartbeat with another ``generation`` than the group's is stale, one of no member unknown; neither changes
    anything. A null generation stands for the present one. A join always makes a new generation, also of who is there.
    """

    def step(state: dict, row: dict) -> dict:
        seen, kind, outcome = state.setdefault("seen", {}), row["kind"], "ok"
        silent = [m for m, at in seen.items() if row["ts_ms"] - at >= timeout_ms]
        for m in silent:
            del seen[m]
        generation = state.get("generation", 0) + bool(silent)
        if kind != "join" and row["generation"] is not None and row["generation"] != generation:
            outcome = "stale"
        elif kind != "join" and row["member"] not in seen:
            outcome = "unknown"
        elif kind == "leave":
            del seen[row["member"]]
            generation += 1
        else:
            seen[row["member"]] = row["ts_ms"]
            generation += kind == "join"
        state["generation"] = generation
        return {"group_id": row["group_id"], "seq": row["seq"], "outcome": outcome, "generation": generation, "members": sorted(seen)}

    return ordered_fold(events, ["group_id"], ["seq"], step, "group_id string, seq long, outcome string, generation long, members array<string>")


def sticky(previous: dict[int, str], members: list[str], partitions: int) -> dict[int, str]:
    """Each partition's owner: the one before while it has room, else the least loaded, by name where loads tie."""
    load, most, owner = dict.fromkeys(members, 0), -(-partitions // len(members)), {}
    for p in range(partitions):
        before = previous.get(p)
        owner[p] = before if load.get(before, most) < most else min(members, key=lambda m: (load[m], m))
        load[owner[p]] += 1
    return owner


def planned_moves(placements: DataFrame, brokers: list[dict]) -> DataFrame:
    """(cluster, stream, part, src, dst): replicas that move from the fullest to the least full broker.

    A broker's score is its share of disk used in millionths, then partitions, leaders, throughput and id; moves change the
    counts that later partitions see. ``brokers`` is a cluster's list of machines, which travels with the task.
    """

    def step(load: dict, row: dict) -> dict:
        if not load:
            load.update({b["node"]: {**b} for b in brokers})
        def score(n):
            b = load[n]
            full = b["disk_used"] * 1_000_000 // b["disk_capacity"] if b["disk_capacity"] else float("inf")
            return full, b["partitions"], b["leaders"], b["throughput"], n

        held = [n for n in row["replicas"] if n in load]
        src = max(held, key=score, default=None)
        dst = None
        if src is not None:
            regions, allowed = len({load[n]["region"] for n in held}), row["allowed_regions"]
            fit = [n for n, b in load.items() if b["eligible"] and n not in row["replicas"] and (not allowed or b["region"] in allowed)
                   and (b["region"] != load[src]["region"] or row["min_regions"] <= regions)]
            dst = min(fit, key=score, default=None)
        if dst is not None and score(dst) < score(src):
            load[src]["partitions"] = max(load[src]["partitions"] - 1, 0)
            load[src]["leaders"] = max(load[src]["leaders"] - (row["leader"] == src), 0)
            load[dst]["partitions"] += 1
            load[dst]["leaders"] += row["leader"] == dst
        else:
            src = dst = None
        return {"cluster": row["cluster"], "stream": row["stream"], "part": row["part"], "src": src, "dst": dst}

    return ordered_fold(placements, ["cluster"], ["stream", "part"], step, "cluster string, stream string, part int, src int, dst int").filter("dst is not null")
