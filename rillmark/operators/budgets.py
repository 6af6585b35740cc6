"""Folds of budgets, acknowledgement windows and registrations, and assignments that move as little as they can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.operators.folds import DIMENSIONS, ordered_fold, sticky


def sticky_assignment(members: DataFrame, partitions: int, before: Callable[[int, int], int | None]) -> DataFrame:
    """(grp, part, member) of each group; before(part, members) tells which of the members by name, if any, owned a part."""
    groups = members.groupBy("grp").agg(F.array_sort(F.collect_set("member")).alias("members"))  # a group's members

    def step(state: dict, row: dict) -> dict:
        names = row["members"]
        held = {p: names[i] for p in range(partitions) if (i := before(p, len(names))) is not None}
        owners = sticky(held, names, partitions)
        return {"grp": row["grp"], "owners": [owners[p] for p in range(partitions)]}

    return ordered_fold(groups, ["grp"], [], step, "grp string, owners array<string>").select("grp", F.posexplode("owners").alias("part", "member"))


def ack_window(acks: DataFrame, window: int) -> DataFrame:
    """(consumer, seq, outcome, committed): an acknowledgement is stale below the committed offset, and refused when it finds
    ``window`` others beyond a gap that it doesn't close; the committed offset is one past the unbroken run."""

    def step(state: dict, row: dict) -> dict:
        done, held, off, outcome = state.get("done", 0), state.setdefault("held", set()), row["off"], "acked"
        if off < done:
            outcome = "stale"
        elif off not in held and len(held) >= window and off != done:
            outcome = "window"
        else:
            held.add(off)
            while done in held:
                held.discard(done)
                done += 1
            state["done"] = done
        return {"consumer": row["consumer"], "seq": row["seq"], "outcome": outcome, "committed": done}

    return ordered_fold(acks, ["consumer"], ["seq"], step, "consumer long, seq long, outcome string, committed long")


def work_classes(events: DataFrame, max_records: int, max_bytes: int, max_concurrency: int) -> DataFrame:
    """(class, seq, ok, records, bytes, concurrency) after each reserve, which is whole or not at all, or release, never below 0."""

    def step(s: dict, row: dict) -> dict:
        r, b, c = s.get("r", 0), s.get("b", 0), s.get("c", 0)
        ok = row["kind"] == "release" or (r + row["records"] <= max_records and b + row["bytes"] <= max_bytes and c + 1 <= max_concurrency)
        if ok:
            sign = -1 if row["kind"] == "release" else 1
            s.update(r=max(0, r + sign * row["records"]), b=max(0, b + sign * row["bytes"]), c=max(0, c + sign))
        return {"class": row["class"], "seq": row["seq"], "ok": ok, "records": s.get("r", 0), "bytes": s.get("b", 0), "concurrency": s.get("c", 0)}

    return ordered_fold(events, ["class"], ["seq"], step, "class long, seq long, ok boolean, records long, bytes long, concurrency long")


def transfers(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(pool, seq, outcome) of reservations and of transfers between the tenants of a pool: a transfer needs all of it at its
    source and room for all of it at its target, else nothing moves.

    requests: pool, seq, source (null: a reservation), target and the dimensions. A pool's tenants share a task.
    """

    def step(used: dict, row: dict) -> dict:
        want, target = {d: row[d] for d in DIMENSIONS}, used.setdefault(row["target"], dict.fromkeys(DIMENSIONS, 0))
        source = used.setdefault(row["source"], dict.fromkeys(DIMENSIONS, 0)) if row["source"] is not None else None
        if source is target:
            outcome = "moved"
        elif source is not None and any(source[d] < want[d] for d in DIMENSIONS):
            outcome = "lacking"
        elif any(target[d] + want[d] > limits[d] for d in DIMENSIONS):
            outcome = "full"
        else:
            outcome = "reserved" if source is None else "moved"
            for d in DIMENSIONS:
                target[d] += want[d]
                if source is not None:
                    source[d] -= want[d]
        return {"pool": row["pool"], "seq": row["seq"], "outcome": outcome}

    return ordered_fold(requests, ["pool"], ["seq"], step, "pool long, seq long, outcome string")


def json_follows(old: str, new: str) -> bool:
    """Every field required before is still a property, and a newly required one has a default."""
    o, n = json.loads(old), json.loads(new)
    before, properties = o.get("required", []), n.get("properties", {})
    return all(f in properties for f in before) and all(f in before or "default" in properties.get(f, {}) for f in n.get("required", []))


def registered(registrations: DataFrame, follows: Callable[[str, str], bool] = json_follows) -> DataFrame:
    """(subject, seq, version, id): a definition that can follow its subject's last accepted one gets the next version, another none.

    Ids number the accepted definitions of all subjects in order: sums in two levels, over ranges of ``seq`` and within one.
    """

    def step(s: dict, row: dict) -> dict:
        ok = "last" not in s or follows(s["last"], row["definition"])
        if ok:
            s.update(last=row["definition"], n=s.get("n", 0) + 1)
        return {"subject": row["subject"], "seq": row["seq"], "version": s["n"] if ok else None}

    from pyspark.sql import Window

    out = ordered_fold(registrations, ["subject"], ["seq"], step, "subject string, seq long, version long").withColumn("_b", F.floor(F.col("seq") / (1 << 20)))
    per = out.groupBy("_b").agg(F.count("version").alias("_n"))
    before = per.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.count("version").over(Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_w", within).join(before, "_b").select("subject", "seq", "version", F.when(F.col("version").isNotNull(), F.col("_before") + F.col("_w")).alias("id"))
