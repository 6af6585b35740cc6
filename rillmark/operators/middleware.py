"""Middleware: functions that see messages of a stage and pattern and let them pass, change, drop, reject or add to them.

A registry holds generations of modules; installing makes a new one, and a rollback changes places with the one before.
The first module that doesn't let a message continue ends its way. What fails is undone: the message is again what the
module got, and its policy says whether it goes on, is dropped, or stops the job. There is no fuel or memory budget:
a task's limits are Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from rillmark.functions import subjects

STAGES = ("ingress", "route", "before_commit", "after_commit", "before_deliver", "after_deliver")
#: What a stage may change; after the commit what is stored stays.
MUTABLE = {"ingress": {"subject", "payload"}, "route": {"subject", "payload"}, "before_commit": {"payload"}, "before_deliver": {"payload"}}
MAX_EMITTED, MAX_DEPTH = 8, 2


@dataclass(frozen=True)
class Module:
    """``process(message)`` returns (decision, changes, emitted): "continue", "drop" or "reject", new fields, and further messages."""

    name: str
    stage: str
    pattern: str
    process: Callable[[dict], tuple[str, dict, list[dict]]]
    on_failure: str = "closed"  # or "open" or "drop"


@dataclass
class Registry:
    current: tuple[int, tuple[Module, ...]] = (0, ())
    previous: tuple[int, tuple[Module, ...]] | None = field(default=None)

    def install(self, modules: list[Module]) -> int:
        for m in modules:
            if m.stage not in STAGES or not re.search(subjects.PATTERN, m.pattern):
                raise ValueError(f"{m.name}: no such stage or an invalid pattern")
        self.previous, self.current = self.current, (self.current[0] + 1, tuple(modules))
        return self.current[0]

    def rollback(self) -> int:
        if self.previous is None:
            raise ValueError("no generation to go back to")
        self.current, self.previous = self.previous, self.current
        return self.current[0]


def processed(message: dict, stage: str, modules: tuple[Module, ...], depth: int = 0) -> tuple[str, dict, list[dict]]:
    """(decision, message, emitted) after the modules of a stage whose pattern the subject matched at the start."""
    emitted, start = [], message["subject"]
    for m in modules:
        if m.stage != stage or not re.search(subjects.to_regex(m.pattern), start):
            continue
        try:
            if depth > MAX_DEPTH:
                raise ValueError("too deep")
            decision, changes, more = m.process(dict(message))
            if len(more) > MAX_EMITTED or set(changes) - MUTABLE.get(stage, set()) or decision not in ("continue", "drop", "reject"):
                raise ValueError("the module's answer isn't allowed")
        except Exception as e:  # noqa: BLE001 - whatever a module raises is its failure
            if m.on_failure == "closed":
                raise RuntimeError(f"{m.name}: {e}") from e
            return ("continue" if m.on_failure == "open" else "drop"), message, emitted
        message = message | changes
        emitted += more
        if decision != "continue":
            return decision, message, emitted
    return "continue", message, emitted


def applied(messages: DataFrame, registry: Registry, stage: str) -> DataFrame:
    """messages (subject, payload and other columns) with what a stage made of them, and ``decision``, ``generation``, ``emitted``."""
    generation, modules = registry.current
    names = messages.columns

    def run(batches):
        for batch in batches:
            out = [processed(row, stage, modules) for row in batch.to_pylist()]
            columns = [pa.array([m[c] for _, m, _ in out], batch.schema.field(c).type) if c in ("subject", "payload") else batch.column(c) for c in names]
            emitted = pa.array([[{"subject": e["subject"], "payload": e["payload"]} for e in x] for _, _, x in out], pa.list_(pa.struct([("subject", pa.string()), ("payload", pa.string())])))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d for d, _, _ in out]), pa.array([generation] * len(out), pa.int64()), emitted], [*names, "decision", "generation", "emitted"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInArrow(run, f"{ddl}, decision string, generation long, emitted array<struct<subject: string, payload: string>>")
