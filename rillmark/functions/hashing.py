"""FNV-1a with 64 bits as an expression: two halves of 32 bits, so that nothing overflows in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW, MASK = 3421674724, 2216829733, 0xFFFFFFFF


def _bytes(c: Column) -> Column:
    """A string's or binary's bytes as numbers: as Latin-1 each byte is one character, whose code it is."""
    text = F.decode(c.cast("binary"), "ISO-8859-1")
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a(c: Column) -> Column:
    """(hi, lo) of the hash of a string's or binary's bytes."""

    def step(state, b):
        x = state["lo"].bitwiseXOR(b)
        m = x * 435
        low = m.bitwiseAND(F.lit(MASK))
        high = (state["hi"] * 435 + F.shiftright(m, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(MASK))
        return F.struct(high.alias("hi"), low.alias("lo"))

    return F.aggregate(_bytes(c), F.struct(F.lit(HIGH).cast("long").alias("hi"), F.lit(LOW).cast("long").alias("lo")), step)


def modulo(hashed: Column, n: int) -> Column:
    """The unsigned remainder. Inside a function of one element the hash is computed once, not for each half."""
    rest = F.transform(F.array(hashed), lambda h: ((h["hi"] % n) * (4294967296 % n) + h["lo"] % n) % n)
    return F.get(rest, F.lit(0)).cast("int")


def partition_of(key: Column, n: int) -> Column:
    return modulo(fnv1a(key), n)
