"""Literal cases of single functions and operators."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillmark.functions import hashing, scalars, subjects
from rillmark.operators import consumption, folds, lifecycle, routing, state


@pytest.mark.parametrize(("pattern", "subject", "want"), [("orders/*", "orders/created", True), ("orders/*", "orders/us/created", False), ("orders/**", "orders/us/created", True), ("orders/**", "orders", True), ("**", "anything", True), ("a/*/c", "a/b/c", True)])
def test_patterns(spark, pattern, subject, want):
    assert spark.range(1).select(subjects.matches(F.lit(subject), pattern).alias("m")).first().m is want


def test_subject_and_pattern_syntax(spark):
    bad = ["/orders", "orders/", "orders//created", "orders/*", ""]
    assert not any(r.ok for r in spark.createDataFrame([(b,) for b in bad], "s string").select(subjects.valid_subject(F.col("s")).alias("ok")).collect())
    rows = spark.createDataFrame([("orders/**/created",), ("orders/foo*",), ("a/*/b",), ("**",), ("a/**",)], "s string")
    assert [r.ok for r in rows.select(subjects.valid_pattern(F.col("s")).alias("ok")).collect()] == [False, False, True, True, True]


def _plain(p, s):
    def go(p, s):
        if not p:
            return not s
        if p[0] == "**":
            return True
        return bool(s) and p[0] in ("*", s[0]) and go(p[1:], s[1:])

    return go(p, s)


_SEG = st.sampled_from(["a", "b", "*"])


@given(st.lists(_SEG, min_size=1, max_size=3), st.booleans(), st.lists(st.sampled_from(["a", "b"]), min_size=1, max_size=4))
def test_regex_is_the_pattern(parts, tail, subject):
    import re

    p = parts + ["**"] * tail
    assert bool(re.match(subjects.to_regex("/".join(p)), "/".join(subject))) == _plain(p, subject)


@given(st.lists(_SEG, min_size=1, max_size=3), st.booleans(), st.lists(_SEG, min_size=1, max_size=3))
def test_overlap_finds_every_common_subject(a, tail, b):
    import itertools

    p, q = a + ["**"] * tail, b
    common = any(_plain(p, s) and _plain(q, s) for n in range(1, 5) for s in itertools.product("ab", repeat=n))
    assert not common or subjects.overlap("/".join(p), "/".join(q))


def test_fan_out_is_the_nested_loop(spark):
    subjects_ = ["a", "a/b", "a/b/c", "b/x", "a/x"]
    patterns = [("1", "a/**"), ("2", "a/*"), ("3", "a/b"), ("4", "**"), ("5", "*/b"), ("6", "*/*/c")]
    got = {(r.subject, r.subscriber) for r in routing.fan_out(spark.createDataFrame([(s,) for s in subjects_], "subject string"), patterns).collect()}
    assert got == {(s, o) for s in subjects_ for o, p in patterns if _plain(p.split("/"), s.split("/"))}


def test_fnv(spark):
    def plain(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    for s in ("", "a", "hello", "größe", "events/click/7"):
        r = spark.range(1).select(hashing.fnv1a(F.lit(s)).alias("h"), hashing.partition_of(F.lit(s), 13).alias("p")).first()
        assert (r.h.hi << 32) + r.h.lo == plain(s.encode()) and r.p == plain(s.encode()) % 13


def _log(spark, rows):
    return spark.createDataFrame([("s", 0, *r) for r in rows], "stream string, part int, off long, ts_ms long, key string, seq long, bytes long")


def test_retention_drops_only_a_prefix(spark):
    log = _log(spark, [(0, 0, "a", 1, 10), (1, 90, "b", 2, 10), (2, 5, "c", 3, 10)])
    assert [r.off for r in lifecycle.retained_by_age(log, 100, 50).orderBy("off").collect()] == [1, 2]
    assert [r.off for r in lifecycle.retained_by_bytes(log, 25).orderBy("off").collect()] == [1, 2]
    assert lifecycle.retained_by_bytes(log, 5).count() == 0
    status = lifecycle.retention_status(log, 100, 10**9, 5).first()
    assert (status.earliest, status.next_offset, status.deleted_messages) == (3, 3, 3)


def test_compaction_keeps_unkeyed(spark):
    log = _log(spark, [(0, 0, "a", 1, 1), (1, 0, None, 2, 1), (2, 0, "a", 3, 1), (3, 0, None, 4, 1)])
    assert sorted(r.off for r in lifecycle.compacted(log).collect()) == [1, 2, 3]


def test_view_fold(spark):
    rows = [("a", "new", 1), ("a", "old", 0), ("b", "two", 2), ("a", None, 3)]
    df = spark.createDataFrame([(k, v, "s", 0, o) for k, v, o in rows], "key string, value string, stream string, part int, off long")
    assert [(r.key, r.value) for r in lifecycle.view(df).collect()] == [("b", "two")]


def test_start_offsets(spark):
    r = consumption.start_offsets(_log(spark, [(0, 0, "a", 1, 1), (1, 10, "a", 2, 1)]), 5, 1).first()
    assert (r.earliest, r.latest, r.at_offset, r.at_time) == (0, 2, 1, 1)


def test_committed_prefix(spark):
    log = _log(spark, [(i, 0, "a", i, 1) for i in range(3)])
    assert consumption.committed(log, F.lit(True), F.col("off") == 1).first().committed == 0
    assert consumption.committed(log, F.lit(True), F.col("off") < 2).first().committed == 2


def test_assignments(spark):
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "grp string, member string")
    for how in ("range", "robin"):
        got = consumption.assigned(11, m, how).collect()
        assert sorted(r.part for r in got) == list(range(11)) and {r.member for r in got} == {"a", "b", "c"}
    assert folds.sticky({0: "b", 1: "b", 3: "x"}, ["a", "b"], 4) == {0: "b", 1: "b", 2: "a", 3: "a"}


def test_transactions(spark):
    ev = spark.createDataFrame([("t", "begin", 1, 100), ("t", "commit", 2, 100), ("u", "begin", 1, 10)], "txn string, kind string, seq long, deadline_ms long")
    assert {r.txn: r.state for r in state.transaction_states(ev, 50).collect()} == {"t": "commit", "u": "abort"}


def test_durations_and_delays(spark):
    df = spark.createDataFrame([("250ms",), ("30s",), ("x",)], "s string")
    assert [r.d for r in df.select(scalars.duration_ms(F.col("s")).alias("d")).collect()] == [250, 30_000, None]
    d = spark.range(1, 5).select(scalars.retry_delay(F.col("id"), 100, 500).alias("d"))
    assert [r.d for r in d.collect()] == [100, 200, 400, 500]
