"""Functions of load generators, acknowledgement addresses and names; all arithmetic is that of unsigned 64-bit numbers where it matters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillmark.functions import hashing

#: Fixed value: the multiplier of xorshift*.
MULTIPLIER = 2685821657736338717
WRAP = 1 << 64
MAX_U64 = WRAP - 1


def _unsigned(c: Column) -> Column:
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(Decimal(WRAP))).otherwise(d)


def deterministic_index(sequence: Column, cardinality: int, seed: int) -> Column:
    """A number below ``cardinality`` by xorshift* of the sequence and a seed."""
    if cardinality <= 1:
        return F.lit(0).cast("long")
    v = sequence.cast("long").bitwiseXOR(F.lit(seed).cast("long"))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 12))
    v = v.bitwiseXOR(F.shiftleft(v, 25))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 27))
    # below 2**126, so that 38 digits hold the product
    product = (_unsigned(v) * F.lit(Decimal(MULTIPLIER))).cast("decimal(38,0)")
    return ((product % F.lit(Decimal(WRAP))) % F.lit(Decimal(cardinality))).cast("long")


def selected_subject(target: str, sequence: Column, subjects: int, seed: int, order: str = "random") -> Column:
    if subjects == 1:
        return F.lit(target)
    index = deterministic_index(sequence, subjects, seed) if order == "random" else F.pmod(sequence, F.lit(subjects))
    return F.concat(F.lit(target + "/"), index.cast("string"))


def selected_key(sequence: Column, cardinality: int, seed: int) -> Column:
    """Null where there are no keys."""
    return F.concat(F.lit("key-"), deterministic_index(sequence, cardinality, seed).cast("string")) if cardinality > 0 else F.lit(None).cast("string")


def pacing_delay_ns(operation: Column, workers: int, throughput: int, sleep_ms: int) -> Column:
    """How long after the start an operation is due: by throughput or by a pause each time, whichever is later."""
    by_rate = F.floor(operation.cast("decimal(20,0)") * F.lit(Decimal(workers * 1_000_000_000)) / F.lit(Decimal(throughput))).cast("long") if throughput else F.lit(0).cast("long")
    return F.greatest(by_rate, (operation * sleep_ms * 1_000_000).cast("long"))


def saturating_add(a: Column, b: Column, most: int) -> Column:
    return F.least(F.coalesce(F.try_add(a, b), F.lit(most)), F.lit(most)).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0)).cast("long")


def ack_subject(consumer: Column, seq: Column, delivery: Column, prefix: str = "_ACK") -> Column:
    return F.concat_ws("/", F.lit(prefix), consumer, seq.cast("string"), delivery.cast("string"))


def parsed_ack_subject(subject: Column, prefix: str = "_ACK") -> Column:
    """(consumer, seq, delivery), or null if it is no such address."""
    p = F.split(subject, "/")
    number = lambda i: F.when(F.get(p, i).rlike(r"^\+?[0-9]+$"), F.get(p, i).try_cast("decimal(20,0)"))
    seq, delivery = number(2), number(3)
    fits = (F.size(p) == 4) & (F.get(p, 0) == prefix) & (seq <= F.lit(Decimal(MAX_U64))) & (delivery <= F.lit(Decimal(MAX_U64)))
    return F.when(fits, F.struct(F.get(p, 1).alias("consumer"), seq.cast("long").alias("seq"), delivery.cast("long").alias("delivery")))


def jittered(delay: Column, attempt: Column, percent: int, most: int) -> Column:
    """A retry delay moved by up to ``percent`` of it, by a fixed sequence over attempts; within 0 and ``most``."""
    spread = F.floor(delay * percent / 100).cast("long")
    offset = F.pmod(attempt * 1_664_525 + 1_013_904_223, spread * 2 + 1) - spread
    return F.when(F.lit(percent == 0) | (delay == 0), delay).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), delay + offset))).cast("long")


def valid_message(subject: Column, reply_to: Column, headers: Column) -> Column:
    """Whether a message may be published: unlike a subscription's subject, this one may hold ``>``."""
    ok = subject.rlike(r"^[^/\s*]+(/[^/\s*]+)*$") & (reply_to.isNull() | reply_to.rlike(r"^\S+$"))
    return F.coalesce(ok & F.forall(headers, lambda h: h["name"].rlike(r"^[^:\s]+$") & (F.size(h["values"]) > 0)), F.lit(False))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^._\s][^.\s]*$"), F.lit(False))


def valid_view_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.-]{1,128}$"), F.lit(False))


def state_shard(kind: str, value: Column, shards: int, partition: Column | None = None) -> Column:
    """The owner of a piece of state; a partition's key is its stream and its number as four bytes, the others' have their kind before them."""
    if kind == "partition":
        key = F.concat(value.cast("binary"), F.unhex(F.lpad(F.hex(partition.cast("long")), 8, "0")))
    else:
        key = F.concat(F.lit(kind + ":"), value).cast("binary")
    return hashing.modulo(hashing.fnv1a(key), shards)
