"""The cluster's metadata as a machine of commands: what isn't allowed changes nothing ("noop").

Commands on a partition depend on that partition alone, so each is a key of its own; consumers, groups and policies are
kept by their last command.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.folds import ordered_fold


def _reconfigured(s: dict, row: dict) -> bool:
    """Whether a reconfiguration is allowed; it is then done."""
    replicas, active, same = set(row["replicas"] or ()), set(row["active"] or ()), ("generation", "phase", "replicas", "active", "leader", "epoch")
    if not s["generation"] <= row["generation"] <= s["generation"] + 1:
        return False
    if not active or not active <= replicas or row["leader"] not in active or (row["phase"] == "stable" and 2 * len(active) <= len(replicas)):
        return False
    if row["phase"] == "activating" and (row["offset"] is None or s.get("committed", (None,))[0] != row["offset"] or s["committed"][1] != row["checksum"]):
        return False
    new = {"generation": row["generation"], "phase": row["phase"], "replicas": replicas, "active": active, "leader": row["leader"], "epoch": row["epoch"]}
    if all(s[k] == new[k] for k in same):
        return True
    if row["epoch"] < s["epoch"] or (row["epoch"] == s["epoch"] and row["leader"] != s["leader"]):
        return False
    s.update(new)
    return True


def _committed(s: dict, row: dict) -> bool:
    """Whether a commit is allowed, by the leader of a stable partition, at the next offset; a repeated one is."""
    if (row["leader"], row["epoch"]) != (s["leader"], s["epoch"]) or row["leader"] not in s["active"] or s["phase"] != "stable":
        return False
    this = row["offset"], row["checksum"], row["leader"], row["epoch"]
    if s.get("committed") == this:
        return True
    if "committed" in s and row["epoch"] < s["committed"][3] or row["offset"] != s["next"]:
        return False
    s.update(committed=this, next=row["offset"] + 1)
    return True


def partition_commands(commands: DataFrame, replicas: list[int], leader: int) -> DataFrame:
    """(stream, part, seq, ok, leader, epoch, next_offset, generation) after each command.

    commands: stream, part, seq, kind (leader, commit, reconfigure), leader, epoch, offset, checksum, generation, phase,
    replicas, active. A partition starts with the given replicas, all active, and the leader in epoch 1.
    """

    def step(s: dict, row: dict) -> dict:
        if not s:
            s.update(leader=leader, epoch=1, next=0, generation=0, phase="stable", replicas=set(replicas), active=set(replicas))
        if row["kind"] == "reconfigure":
            ok = _reconfigured(s, row)
        elif row["kind"] == "commit":
            ok = _committed(s, row)
        else:
            ok = (row["leader"], row["epoch"]) == (s["leader"], s["epoch"])
            if not ok and row["epoch"] == s["epoch"] + 1 and row["leader"] in s["active"] and s["phase"] == "stable":
                s.update(leader=row["leader"], epoch=row["epoch"])
                ok = True
        return {"stream": row["stream"], "part": row["part"], "seq": row["seq"], "ok": ok, "leader": s["leader"], "epoch": s["epoch"], "next_offset": s["next"], "generation": s["generation"]}

    return ordered_fold(commands, ["stream", "part"], ["seq"], step, "stream string, part int, seq long, ok boolean, leader long, epoch long, next_offset long, generation long")


def policies(commands: DataFrame) -> DataFrame:
    """(scope, seq, generation) with ``ok``: a snapshot of a policy replaces one of its own or an earlier generation."""
    before = F.max("generation").over(Window.partitionBy("scope").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return commands.withColumn("ok", F.coalesce(F.col("generation") >= before, F.lit(True)))


def expansions(commands: DataFrame) -> DataFrame:
    """(stream, seq, partitions, epoch) with ``ok``: an update of a stream's partitions needs more of them and a later epoch.

    What is refused may have either greater than the state, so each depends on the ones before: a fold by stream.
    """

    def step(s: dict, row: dict) -> dict:
        ok = row["partitions"] > s.get("partitions", 1) and row["epoch"] > s.get("epoch", 1)
        if ok:
            s.update(partitions=row["partitions"], epoch=row["epoch"])
        return {"stream": row["stream"], "seq": row["seq"], "ok": ok, "partitions": s.get("partitions", 1), "epoch": s.get("epoch", 1)}

    return ordered_fold(commands, ["stream"], ["seq"], step, "stream string, seq long, ok boolean, partitions long, epoch long")
