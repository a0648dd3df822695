"""Spans of pattern matches in whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are placed at once.
RUN = 256
SPAN = "array<struct<start:bigint,stop:bigint,hit:string,part:string>>"


def runs(rows: Column) -> Column:
    """rows, an array, cut into arrays of RUN; one empty array if there are none. rows must be a lambda's variable or a column."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / RUN).cast("int")), lambda i: F.slice(rows, i * RUN + 1, F.lit(RUN)))


def placed(rows: Column, length, items) -> Column:
    """All of items(row, start), arrays, one behind the other; start is the sum of length(row) over the rows before.

    An array grows by copying, so running sums are taken in runs of RUN rows and then over the runs: a text of many matches takes time in proportion.
    """
    whole = F.lit(0).cast("long")

    def starts(cut):
        nothing = F.struct(whole.alias("at"), F.array().cast("array<bigint>").alias("all"))
        ends = lambda a, run: F.struct((a["at"] + F.aggregate(run, whole, lambda n, row: n + length(row))).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        return F.aggregate(cut, nothing, ends, lambda a: a["all"])

    def within(run, start):
        nothing = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
        each = F.aggregate(run, nothing, lambda a, row: F.struct((a["at"] + length(row)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
        return F.flatten(F.zip_with(run, each, items))

    # a lambda's variable is computed once
    of_runs = lambda cut: F.flatten(F.zip_with(cut, starts(cut), within))
    return F.get(F.transform(F.array(rows), lambda r: F.get(F.transform(F.array(runs(r)), of_runs), F.lit(0))), F.lit(0))


def matches(text: Column, pattern: str, keep, part: int = 0, gate: str | None = None) -> Column:
    """The leftmost non-overlapping matches as an array of (start, stop, hit, part) in code points; `keep(hit, part)` drops failing ones.

    A match's place follows from the lengths of the matches and of the pieces between them. `part` is a group's number. Texts that
    don't match `gate` (a cheaper, necessary pattern; else the pattern itself) cost one search.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.regexp_extract_all(text, F.lit(pattern), part) if part else hits
    rows = F.arrays_zip(between.alias("gap"), hits.alias("hit"), parts.alias("part"))
    empty = F.array().cast(SPAN)

    def items(row, at):
        start = at + F.length(row["gap"])
        span = F.struct(start.alias("start"), (start + F.length(row["hit"])).alias("stop"), row["hit"].alias("hit"), row["part"].alias("part"))
        return F.when(row["hit"].isNotNull() & keep(row["hit"], row["part"]), F.array(span)).otherwise(empty)

    return F.when(text.rlike(gate or pattern), placed(rows, lambda row: F.length(row["gap"]) + F.coalesce(F.length(row["hit"]), F.lit(0)), items)).otherwise(empty)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def in_order(kinds: list[tuple[str, Column]]) -> Column:
    """(start, rank of the kind, kind, stop) of all spans, sorted."""
    def tagged(rank, kind, spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    return F.sort_array(F.concat(*(tagged(i, k, c) for i, (k, c) in enumerate(kinds))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
