"""Small scalar functions of the log: sizes, headers, delays, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by name without regard to case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def without_headers(headers: Column, names: list[str]) -> Column:
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin([n.lower() for n in names]))


def _size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def record_bytes(namespace, stream, subject, key, payload, headers=None) -> Column:
    """The binary batch size of a record without reply address and schema: what retention counts."""
    head = F.aggregate(headers, F.lit(0), lambda a, h: a + 8 + F.octet_length(h["name"]) + F.octet_length(h["value"])) if headers is not None else F.lit(0)
    return (F.lit(8 + 17 + 4 + 4 + 4 + 8 + 4 + 4 + 8 + 1 + 1 + 4 + 24) + _size(namespace) + _size(stream) + _size(subject) + F.when(key.isNull(), 1).otherwise(5 + _size(key)) + head + _size(payload)).cast("long")


def quota_bytes(*columns: Column) -> Column:
    total = F.lit(128)
    for c in columns:
        total = total + _size(c)
    return total.cast("long")


def retry_delay(attempt: Column, initial: int, most: int, exponential: bool = True) -> Column:
    """Fixed, or doubled per attempt; never above ``most`` (jitter left out: it is 0 by default)."""
    if not exponential:
        return F.lit(min(initial, most)).cast("long")
    return F.least(F.lit(most).cast("long"), F.lit(initial).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.least(attempt - 1, F.lit(30)).cast("int")))


def duration_ms(c: Column) -> Column:
    """``250ms``, ``30s``, ``5m``, ``1h`` as milliseconds; null for anything else."""
    n = F.try_to_number(F.regexp_extract(c, r"^(\d{1,12})(ms|s|m|h)$", 1), F.lit("999999999999")).cast("long")
    unit = F.regexp_extract(c, r"^(\d{1,12})(ms|s|m|h)$", 2)
    return n * F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000)


def position_key(stream: Column, partition: Column) -> Column:
    return F.concat(stream, F.lit(":"), F.lpad(partition.cast("string"), 10, "0"))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def work_share(total: int, workers: int, worker: Column) -> Column:
    return (F.lit(total // workers) + F.when(worker < total % workers, 1).otherwise(0)).cast("long")
