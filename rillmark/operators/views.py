"""A registry of views: what exists, what is paused, and tables that are rebuilt from the log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import subjects
from rillmark.operators import lifecycle


@dataclass
class View:
    name: str
    tenant: str
    stream: str
    pattern: str = "**"
    key: Column | None = None
    paused: bool = False
    rows: DataFrame | None = field(default=None, repr=False)


class ViewRegistry:
    """Views by tenant and name, at most ``most`` of a tenant."""

    def __init__(self, most: int = 100):
        self.most, self.views = most, {}

    def create(self, view: View) -> None:
        import re

        if not re.search(subjects.NAME, view.name) or not re.search(subjects.PATTERN, view.pattern):
            raise ValueError("invalid name or pattern")
        if (view.tenant, view.name) in self.views:
            raise ValueError("the view exists")
        if len(self.list(view.tenant)) >= self.most:
            raise ValueError("too many views")
        self.views[view.tenant, view.name] = view

    def list(self, tenant: str) -> list[str]:
        return sorted(n for t, n in self.views if t == tenant)

    def get(self, tenant: str, name: str) -> View:
        if (tenant, name) not in self.views:
            raise KeyError(name)
        return self.views[tenant, name]

    def pause(self, tenant: str, name: str) -> None:
        self.get(tenant, name).paused = True

    def resume(self, tenant: str, name: str) -> None:
        self.get(tenant, name).paused = False

    def rebuild(self, tenant: str, name: str, log: DataFrame) -> DataFrame:
        """The view's rows from the whole log; a paused one keeps what it has."""
        v = self.get(tenant, name)
        if not v.paused:
            rows = log.filter((F.col("stream") == v.stream) & subjects.matches(F.col("subject"), v.pattern))
            v.rows = lifecycle.view(rows.withColumn("view_key", v.key if v.key is not None else F.col("subject")), "view_key", "payload")
        return v.rows

    def delete(self, tenant: str, name: str) -> None:
        self.get(tenant, name)
        del self.views[tenant, name]
