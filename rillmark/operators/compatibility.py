"""Whether a schema's next definition can follow the last one, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "cast(array() as array<string>)"


def _all_in(some: Column, of: Column) -> Column:
    return F.forall(some, lambda x: F.array_contains(of, x))


def _json(old: Column, new: Column) -> Column:
    """Every field required before is a property; a newly required one has a default."""
    shape = "required array<string>, properties map<string, string>"
    o, n = F.from_json(old, shape), F.from_json(new, shape)
    before, after = (F.coalesce(x["required"], F.expr(_NONE)) for x in (o, n))
    properties = F.coalesce(n["properties"], F.create_map().cast("map<string,string>"))
    default = lambda f: F.coalesce(F.array_contains(F.json_object_keys(F.try_element_at(properties, f)), "default"), F.lit(False))
    return _all_in(before, F.map_keys(properties)) & F.forall(after, lambda f: F.array_contains(before, f) | default(f)) & _is_json(old) & _is_json(new)


def _is_json(text: Column) -> Column:
    return F.get_json_object(text, "$").isNotNull()


def _avro(old: Column, new: Column) -> Column:
    """No field goes; an added one has a default."""
    fields = lambda t: F.coalesce(F.from_json(F.get_json_object(t, "$.fields"), "array<string>"), F.expr(_NONE))
    named = lambda t: F.filter(fields(t), lambda f: F.get_json_object(f, "$.name").isNotNull())
    names = lambda t: F.transform(named(t), lambda f: F.get_json_object(f, "$.name"))
    default = F.transform(F.filter(named(new), lambda f: F.array_contains(F.json_object_keys(f), "default")), lambda f: F.get_json_object(f, "$.name"))
    return _all_in(names(old), names(new)) & _all_in(names(new), F.array_union(names(old), default)) & _is_json(old) & _is_json(new)


def _protobuf(old: Column, new: Column) -> Column:
    """Every number keeps its type and name; a number given twice counts as given last."""
    field = r"(\S+)\s+(\S+)\s*=\s*\+?0*([0-9]+)\s*$"

    def numbered(text: Column) -> Column:
        got = F.filter(F.split(text, ";"), lambda s: s.rlike(field))
        pairs = F.transform(got, lambda s: F.struct(F.regexp_extract(s, field, 3).alias("n"), F.concat_ws(" ", F.regexp_extract(s, field, 1), F.regexp_extract(s, field, 2)).alias("f")))
        empty = F.expr("cast(map() as map<string,string>)")
        return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["n"]), F.map_from_entries(F.array(p))))

    o, n = numbered(old), numbered(new)
    return F.forall(F.map_entries(o), lambda e: F.coalesce(F.try_element_at(n, e["key"]) == e["value"], F.lit(False)))


FORMATS = {"json": _json, "avro": _avro, "protobuf": _protobuf}


def compatible(policy: Column, old_format: Column, old: Column, new_format: Column, new: Column) -> Column:
    """none: always; another format: never; backward, forward (the definitions change places) or full (both)."""

    def follows(a: Column, b: Column) -> Column:
        out = F.lit(False)
        for name, rule in FORMATS.items():
            out = F.when(old_format == name, rule(a, b)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    back, forth = follows(old, new), follows(new, old)
    return (policy == "none") | ((old_format == new_format) & F.when(policy == "backward", back).when(policy == "forward", forth).otherwise(back & forth))
