"""Subjects, patterns and identifiers: ``/``-separated; ``*`` is one segment, a final ``**`` any number, also none."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECT = r"^[^/\s*>]+(/[^/\s*>]+)*$"
PATTERN = r"^(\*\*|([^/\s*>]+|\*)(/([^/\s*>]+|\*))*(/\*\*)?)$"
NAME = r"^[A-Za-z0-9_.-]{1,128}$"
IDENTIFIER = r"^[^._\s][^.\s]*$"
TRACEPARENT = r"^[0-9A-Fa-f]{2}-[0-9A-Fa-f]{32}-[0-9A-Fa-f]{16}-[0-9A-Fa-f]{2}$"


def to_regex(pattern: str) -> str:
    """An anchored expression that matches what the pattern does."""
    if pattern == "**":
        return "^.*$"
    tail = pattern.endswith("/**")
    parts = pattern[:-3].split("/") if tail else pattern.split("/")
    return "^" + "/".join("[^/]*" if p == "*" else re.escape(p) for p in parts) + ("(/.*)?$" if tail else "$")


def literal_prefix(pattern: str) -> str:
    """What every match starts with; a filter on it reaches the scan, which an expression doesn't."""
    parts = []
    for p in pattern.split("/"):
        if p in ("*", "**"):
            break
        parts.append(p)
    return "/".join(parts)


def matches(subject: Column, pattern: str) -> Column:
    if "*" not in pattern:
        return subject == pattern
    return subject.startswith(literal_prefix(pattern)) & subject.rlike(to_regex(pattern))


def overlap(a: str, b: str) -> bool:
    """Whether some subject may match both; a tail wildcard on either side at a point counts as overlap."""
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if "**" in (x, y):
            return True
        if x != y and "*" not in (x, y):
            return False
    na, nb = a.count("/"), b.count("/")
    longer = a if na > nb else b
    return na == nb or longer.split("/")[min(na, nb) + 1] == "**"


def token(subject: Column, n: int) -> Column:
    """The n-th segment from 0, or null."""
    return F.get(F.split(subject, "/"), F.lit(n))


def valid_subject(c: Column) -> Column:
    return F.coalesce(c.rlike(SUBJECT), F.lit(False))


def valid_pattern(c: Column) -> Column:
    return F.coalesce(c.rlike(PATTERN), F.lit(False))
