"""Regular-expression spans with code-point offsets, from built-in functions only, row by row.

``split`` and ``regexp_extract_all`` walk a text by the same leftmost, non-overlapping matches, so
gap and match lengths alternate and their running sum is the end of each match. The sum is taken in
blocks of ``BLOCK`` matches: arrays that grow by an element are copied, and so no longer than a block.
Nothing is shuffled, and no key is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<ord:int,start:int,end:int,hit:string,group:string,before:string,after:string>>"
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``needs``: a literal that every match holds, as a cheap first test. ``group``: a capture to keep."""

    kind: str
    pattern: str
    needs: str | None = None
    group: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


def may_match(text: str, rules: list[Rule]) -> Column:
    """Whether some rule matches; false for null."""
    out = F.lit(False)
    for r in rules:
        hit = F.col(text).rlike(r.pattern)
        out = out | ((F.col(text).contains(r.needs) & hit) if r.needs else hit)
    return F.coalesce(out, F.lit(False))


def unused(df: DataFrame, prefix: str) -> str:
    """``prefix``, longer if a column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def _running(a: Column, first: Column) -> Column:
    """Sums of ``first`` and the elements so far, ``first`` included; for short arrays."""
    return F.aggregate(a, F.array(first), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _blocks(steps: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))


def _bases(steps: Column) -> Column:
    """The sum before each block."""
    part = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    return _running(F.transform(_blocks(steps), lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x)), F.lit(0))


def _ends(steps: Column, bases: Column) -> Column:
    part = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    return F.flatten(F.transform(_blocks(steps), lambda b: F.slice(_running(part(b), F.element_at(bases, b + 1)), F.lit(2), F.lit(BLOCK))))


def with_matches(df: DataFrame, text: str, rules: list[Rule], to: str, context: int = 0, due: str | None = None) -> DataFrame:
    """Adds ``to``, of type ``FOUND``: the matches of each rule in turn, by start.

    ``due`` names an array of rule tags; other rules are not run. ``before`` and ``after`` are up to
    ``context`` characters, ending at the next match of that rule. A null text has no matches.
    """
    p, t, kept = unused(df, "_f"), F.col(text), [c for c in df.columns if c != to]
    col = lambda k, n: F.col(f"{p}{k}{n}")
    matches, others, steps, bases, ends = {}, {}, {}, {}, {}
    for n, rule in enumerate(rules):
        hit = t.rlike(rule.pattern)
        if rule.needs:
            hit = t.contains(rule.needs) & hit
        if due:
            hit = F.array_contains(due, rule.tag) & hit
        m = col("m", n)
        matches[f"{p}m{n}"] = F.when(hit, F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0)))
        others[f"{p}p{n}"] = F.when(m.isNotNull(), F.split(t, rule.pattern, -1))
        if rule.group:
            others[f"{p}g{n}"] = F.when(m.isNotNull(), F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(rule.group)))
        steps[f"{p}s{n}"] = F.transform(F.arrays_zip(m.alias("m"), F.slice(col("p", n), F.lit(1), F.size(m)).alias("p")), lambda x: F.length(x["m"]) + F.length(x["p"]))
        bases[f"{p}b{n}"] = _bases(col("s", n))
        ends[f"{p}e{n}"] = _ends(col("s", n), col("b", n))
    for cols in (matches, others, steps, bases, ends):
        df = df.withColumns({k: F.when(col("m", int(k[len(p) + 1 :])).isNotNull(), c) if cols in (steps, bases, ends) else c for k, c in cols.items()})

    def rows(n: int) -> Column:
        m, g, gaps = col("m", n), col("g" if rules[n].group else "m", n), col("p", n)
        z = F.arrays_zip(m.alias("m"), g.alias("g"), col("e", n).alias("e"), F.slice(gaps, F.lit(1), F.size(m)).alias("p"), F.slice(gaps, F.lit(2), F.size(m)).alias("q"))
        each = F.transform(z, lambda x: F.struct(F.lit(n).alias("ord"), (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("hit"), x["g"].alias("group"), F.right(x["p"], F.lit(context)).alias("before"), F.left(x["q"], F.lit(context)).alias("after")))
        return F.when(m.isNotNull(), each).otherwise(F.array().cast(FOUND))

    return df.select(*kept, F.concat(*(rows(n) for n in range(len(rules)))).alias(to))


def label(kind: Column, s: Column) -> Column:
    return F.concat(kind, F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
