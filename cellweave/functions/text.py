"""JSON out of free text: its first object, and what was cut off put back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string (its end may be missing), a bracket, or a run of anything else. Possessive, so that long strings need no stack.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|[{}\[\]]|[^"{}\[\]]++'
_OPEN, _CLOSE = ("{", "["), ("}", "]")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _fenced(text: Column) -> Column:
    """What stands in a fence marked json, or in the first fence that starts with a brace; else the text."""
    plain = _strip(text)
    marked = _strip(F.split_part(F.split_part(plain, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
    parts = F.filter(F.transform(F.split(plain, "```"), _strip), lambda p: p.startswith("{"))
    return F.when(plain.startswith("{"), plain).when(plain.contains("```json"), marked).when(plain.contains("```") & (F.size(parts) > 0), F.get(parts, F.lit(0))).otherwise(plain)


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, or all from its first brace where the text ends before it does; braces in strings do not count.

    Null without a brace. Text after a fenced object is left out, as is text after the object itself.
    """
    inner = _fenced(text)
    tail = F.substring(inner, F.locate("{", inner), F.char_length(inner))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin(*_OPEN), 1).when(t.isin(*_CLOSE), -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.char_length(t)).alias("n"), (depth <= 0).alias("done")))

    n = F.aggregate(F.regexp_extract_all(tail, F.lit(_TOKENS), F.lit(0)), start, step, lambda s: s["n"])
    return F.when(inner.contains("{"), F.substring(tail, F.lit(1), n))


def closed(json: Column) -> Column:
    """A JSON text whose end is missing, with its string ended, a last comma dropped and open brackets closed, the innermost first."""
    trimmed = F.regexp_replace(json, r"\s+$", "")
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        pushed = F.when(t == "{", F.concat(F.lit("}"), s["open"])).when(t == "[", F.concat(F.lit("]"), s["open"]))
        return F.struct(pushed.when(t.isin(*_CLOSE), F.substring(s["open"], F.lit(2), F.char_length(s["open"]))).otherwise(s["open"]).alias("open"), t.alias("last"))

    end = F.aggregate(F.regexp_extract_all(trimmed, F.lit(_TOKENS), F.lit(0)), start, step)
    cut = end["last"].startswith('"') & ~F.rlike(end["last"], F.lit(r'^"[^"\\]*+(?:\\.[^"\\]*+)*+"$'))
    ended = F.when(cut, F.concat(F.regexp_replace(trimmed, r"(?<!\\)((?:\\\\)*)\\$", "$1"), F.lit('"'))).otherwise(trimmed)
    return F.concat(F.regexp_replace(ended, r"\s*,\s*$|\s+$", ""), end["open"])
