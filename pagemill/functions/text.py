"""Column expressions over texts and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that are white space in Unicode, as ``(?U)\\s`` reads it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space of any kind (not only spaces) at either end."""
    return F.btrim(text, F.lit(WHITE))


def key_values(line: Column) -> Column:
    """``key=value`` tokens of a line as a map; the first sign splits, and a later value of a key wins."""
    tokens = F.filter(F.split(trimmed(line), r"\s+"), lambda t: t.contains("="))
    cut = lambda t: F.instr(t, "=")
    pairs = F.transform(tokens, lambda t, i: F.struct(
        F.substring(t, F.lit(1), cut(t) - 1).alias("key"), F.substring(t, cut(t) + 1, F.length(t)).alias("value"), i.alias("i")))

    def of(pairs: Column) -> Column:
        # each key keeps its last pair, so the map never meets a key twice, whatever the session says about that
        last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["i"] > p["i"])))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))

    return F.transform(F.array(pairs), of)[0]  # the line is cut once, however often its pairs are looked at


def typed_value(raw: Column) -> Column:
    """kind and value of a logged value, after trailing commas: bool, float if it looks like one, int, else text."""
    v = F.regexp_replace(raw, ",+$", "")
    is_bool = F.lower(v).isin("true", "false")
    floating = v.rlike("[.eE]")
    as_float = F.when(floating, v.try_cast("double"))
    as_int = F.when(~floating, F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("long")))
    kind = F.when(is_bool, "bool").when(as_float.isNotNull(), "float").when(as_int.isNotNull(), "int").otherwise("text")
    return F.struct(
        kind.alias("kind"), F.when(is_bool, F.lower(v) == "true").alias("b"), F.when(~is_bool, as_int).alias("i"),
        F.when(~is_bool, as_float).alias("d"), F.when(kind == "text", v).alias("s"))


def stage_line(head: str, fields: Column, separator: str = " ") -> Column:
    """``head`` and ``key=value`` of an array of (key, value), joined by ``separator``."""
    return F.concat_ws(" ", F.lit(head), F.array_join(F.transform(fields, lambda f: F.concat(f["key"], F.lit("="), f["value"])), separator))


def dump_name(name: Column) -> Column:
    """stage, x, y, w, h of ``stage_part_x_y_WxH`` with an optional ``sidecar_`` before it; numbers are null where they do not parse."""
    parts = F.split(F.regexp_replace(name, "^sidecar_", ""), "_")
    sides = F.split(F.get(parts, F.lit(4)), "x", 2)
    number = lambda c: F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))
    return F.struct(
        F.concat_ws("_", F.slice(parts, 1, 2)).alias("stage"), number(F.get(parts, F.lit(2))).alias("x"), number(F.get(parts, F.lit(3))).alias("y"),
        number(F.get(sides, F.lit(0))).alias("w"), number(F.get(sides, F.lit(1))).alias("h"))


def json_text(text: Column) -> Column:
    """A text as JSON; null as an empty one."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
