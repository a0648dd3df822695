"""Incomplete factorizations, colourings, matchings and orderings of one sparse matrix of any size, as rounds of joins over its stored cells.

A row of an incomplete factorization needs the rows of its cells left of the diagonal, so rows are taken by levels: those that wait for nothing, then
those that wait for these, and so on. There are as many rounds as the longest such chain; numbering the rows by colours makes it short. No array
of the matrix's size exists anywhere; a task holds the cells of single rows and of the finished rows that these meet.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.sorting import ranked
from tabulon.operators.sparse import Sparse
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError, Tensor

#: Tables of finished levels that are read side by side before they are written as one.
TABLES = 16


def _square(a: Sparse) -> int:
    if a.shape[0] != a.shape[1]:
        raise ShapeError(f"{a.shape}: a square matrix is needed")
    return a.shape[0]


def _union(tables: list[DataFrame]) -> DataFrame: return functools.reduce(DataFrame.unionByName, tables)


# levels and incomplete factors

def fill_pattern(a: Sparse, level: int = 0) -> DataFrame:
    """row, col, fill of the cells that a factorization with `level` of fill keeps: 0 for stored cells and the diagonal; what elimination of k adds at
    (i, j) has the fills of (i, k) and (k, j) and one more. A fixed point: cells are joined with cells until no fill changes."""
    n, spark = _square(a), a.df.sparkSession
    scratch = Scratch(spark)
    start = a.df.where("v <> 0").select("row", "col").unionByName(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"))).distinct()
    cells = scratch.save(start.withColumn("fill", F.lit(0)), "pattern")
    known = (cells.count(), 0)
    while level:
        left = cells.where("col < row").select("row", F.col("col").alias("k"), F.col("fill").alias("f"))
        right = cells.where("col > row").select(F.col("row").alias("k"), "col", F.col("fill").alias("g"))
        made = left.join(right, "k").select("row", "col", (F.col("f") + F.col("g") + 1).alias("fill")).where(F.col("fill") <= level)
        after = scratch.save(cells.unionByName(made).groupBy("row", "col").agg(F.min("fill").alias("fill")), "pattern")
        scratch.drop(cells)
        cells = after
        found = cells.agg(F.count("*"), F.sum("fill")).first()
        if tuple(found) == known:
            break
        known = tuple(found)
    return cells


def row_levels(a: Sparse) -> DataFrame:
    """row and level: 0 for rows without a stored cell left of the diagonal, else one more than the highest level of the rows of these cells."""
    return _levels(Scratch(a.df.sparkSession), a.df.where("col < row AND v <> 0").select("row", "col"), a.df.sparkSession.range(_square(a)).select(F.col("id").alias("row")))


def _levels(scratch: Scratch, waits: DataFrame, rows: DataFrame) -> DataFrame:
    """Levels of rows from the pairs (row, col) of a row and one that it waits for. A round keeps the pairs whose col waits itself, so a row's level is the
    number of rounds in which it has pairs."""
    pairs, rounds = scratch.save(waits, "waits"), []
    while not pairs.isEmpty():
        waiting = pairs.select("row").distinct()
        rounds.append(waiting)
        pairs = scratch.save(pairs.join(waiting.select(F.col("row").alias("col")), "col", "left_semi"), "waits")
        if len(rounds) == TABLES:
            rounds = [scratch.save(_union(rounds), "rounds")]
    if not rounds:
        return rows.withColumn("level", F.lit(0))
    return rows.join(_union(rounds).groupBy("row").agg(F.count("*").cast("int").alias("level")), "row", "left").fillna(0, ["level"])


def _eliminated(batches):
    """Rows of L and U (row, cols, vals) from rows (row, cells) and the finished rows that they meet (met)."""
    for batch in batches:
        rows, cols, vals = [], [], []
        for i, cells, met in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            own = {c["col"]: c["v"] for c in cells}
            finished = {m["k"]: m for m in met or () if m["k"] is not None}
            for k in sorted(c for c in own if c < i):
                up = dict(zip(finished[k]["cols"], finished[k]["vals"], strict=True))
                if not up.get(k):
                    raise ZeroDivisionError(f"pivot {k} is zero")
                own[k] /= up[k]
                for j, u in up.items():
                    if j > k and j in own:
                        own[j] -= own[k] * u
            rows.append(i)
            cols.append(sorted(own))
            vals.append([own[j] for j in cols[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(cols, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.float64()))], ["row", "cols", "vals"])


@dataclass(frozen=True)
class Factors:
    """cells: row, col, v of the unit lower factor's cells below the diagonal and the upper one's; levels: rounds that it took."""

    cells: DataFrame
    n: int
    levels: int
    scratch: Scratch

    def lower(self) -> Sparse:
        unit = self.cells.sparkSession.range(self.n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v"))
        return Sparse(self.cells.where("col < row").unionByName(unit), (self.n, self.n))

    def upper(self) -> Sparse: return Sparse(self.cells.where("col >= row"), (self.n, self.n))


def ilu(a: Sparse, level: int = 0, pattern: DataFrame | None = None) -> Factors:
    """Incomplete L and U on the cells of `pattern` (row, col; by default fill_pattern(a, level)): the product agrees with the matrix there.

    Cells that are in the pattern but not in the matrix start as zero. A zero pivot ends in a ZeroDivisionError of the task.
    """
    n = _square(a)
    scratch = Scratch(a.df.sparkSession)
    kept = fill_pattern(a, level) if pattern is None else pattern
    cells = scratch.save(kept.select("row", "col").join(a.df, ["row", "col"], "left").fillna(0.0, ["v"]), "cells")
    levels = scratch.save(_levels(scratch, cells.where("col < row").select("row", "col"), cells.select("row").distinct()), "levels")
    rounds = (levels.agg(F.max("level")).first()[0] or 0) + 1
    rows = scratch.save(cells.groupBy("row").agg(F.collect_list(F.struct("col", "v")).alias("cells")).join(levels, "row"), "rows")
    done: list[DataFrame] = []
    for step in range(rounds):
        now = rows.where(F.col("level") == step).select("row", "cells")
        if done:
            wanted = now.select("row", F.explode("cells").alias("c")).where("c.col < row").select("row", F.col("c.col").alias("k"))
            up = _union(done).select(F.col("row").alias("k"), "cols", "vals")
            met = wanted.join(up, "k").groupBy("row").agg(F.collect_list(F.struct("k", F.col("cols"), F.col("vals"))).alias("met"))
            now = now.join(met, "row", "left")
        else:
            now = now.withColumn("met", F.lit(None).cast("array<struct<k:bigint,cols:array<bigint>,vals:array<double>>>"))
        done.append(scratch.save(now.select("row", "cells", "met").mapInArrow(_eliminated, "row long, cols array<long>, vals array<double>"), "done"))
        if len(done) == TABLES:
            done = [scratch.save(_union(done), "done")]
    out = _union(done).select("row", F.explode(F.arrays_zip("cols", "vals")).alias("c")).select("row", F.col("c.cols").alias("col"), F.col("c.vals").alias("v"))
    return Factors(scratch.save(out, "factors"), n, rounds, scratch)


def ic(a: Sparse, level: int = 0) -> Sparse:
    """Incomplete Cholesky factor of a symmetric matrix: L of its incomplete L U times the roots of U's diagonal. ValueError if a pivot isn't positive."""
    f = ilu(a, level)
    roots = f.cells.where("row = col").select("col", F.sqrt(F.when(F.col("v") > 0, F.col("v"))).alias("d"))
    if not roots.where("d IS NULL").isEmpty():
        raise ValueError("the matrix is not positive definite on its pattern")
    return Sparse(f.lower().df.join(roots, "col").select("row", "col", (F.col("v") * F.col("d")).alias("v")), a.shape)


# colours

def _neighbours(a: Sparse) -> DataFrame:
    """row and col of all pairs of different rows that share a stored cell, both ways."""
    off = a.df.where("row <> col AND v <> 0").select("row", "col")
    return off.unionByName(off.select(F.col("col").alias("row"), F.col("row").alias("col"))).distinct()


def colours(a: Sparse, seed: int = 0) -> DataFrame:
    """row and colour (from 0): rows that share a cell differ in colour. Rounds of independent sets: a row whose hash is the greatest among its uncoloured
    neighbours takes the least colour that no coloured neighbour has."""
    n, spark = _square(a), a.df.sparkSession
    scratch = Scratch(spark)
    edges = scratch.save(_neighbours(a), "edges")
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), c), c)
    left, open_edges = scratch.save(spark.range(n).select(F.col("id").alias("row")), "rows"), edges
    done: list[DataFrame] = []
    while not left.isEmpty():
        beaten = open_edges.where(order(F.col("row")) < order(F.col("col"))).select("row").distinct()
        fresh = left.join(beaten, "row", "left_anti")
        if done:
            known = _union(done).select(F.col("row").alias("col"), "colour")
            used = edges.join(fresh, "row", "left_semi").join(known, "col").groupBy("row").agg(F.collect_set("colour").alias("used"))  # as many as there are colours
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
            coloured = fresh.join(used, "row", "left").select("row", F.when(F.col("used").isNull(), 0).otherwise(free).alias("colour"))
        else:
            coloured = fresh.select("row", F.lit(0).alias("colour"))
        coloured = scratch.save(coloured, "colours")
        done.append(coloured)
        gone = coloured.select("row")
        later = scratch.save(left.join(gone, "row", "left_anti"), "rows")
        rest = scratch.save(open_edges.join(gone, "row", "left_anti").join(gone.select(F.col("row").alias("col")), "col", "left_anti"), "open")
        scratch.drop(left, *([open_edges] if open_edges is not edges else []))
        left, open_edges = later, rest
        if len(done) == TABLES:
            done = [scratch.save(_union(done), "colours")]
    return scratch.save(_union(done), "colours") if done else spark.createDataFrame([], "row long, colour int")


def colour_order(a: Sparse, seed: int = 0) -> DataFrame:
    """row and place: rows by colour, so that a factorization in this order has as many levels as there are colours. Gapless from 0."""
    return ranked(colours(a, seed).select("row", "colour"), ["colour", "row"]).select("row", "place")


def permuted(a: Sparse, order: DataFrame) -> Sparse:
    """The matrix with rows and columns at the places of `order` (row, place)."""
    to = lambda c: order.select(F.col("row").alias(c), F.col("place").alias(f"_{c}"))
    return Sparse(a.df.join(to("row"), "row").join(to("col"), "col").select(F.col("_row").alias("row"), F.col("_col").alias("col"), "v"), a.shape)


# matchings

def maximum_matching(a: Sparse) -> DataFrame:
    """row and col of a largest set of stored cells of which no two share a row or a column.

    Columns first propose to rows (each takes its least unmatched row, each row its least suitor) until none is left to take. Then phases of a layered search:
    trees grow from all unmatched columns at once, every row joins the least column that reaches it, so trees share no vertex; where they reach
    unmatched rows, one path of each tree is turned over. The matching is largest when a phase reaches no unmatched row.
    """
    scratch = Scratch(a.df.sparkSession)
    cells = scratch.save(a.df.where("v <> 0").select("row", "col").distinct(), "cells")
    match = scratch.save(cells.limit(0), "match")
    free = lambda c: cells.join(match.select(c), c, "left_anti")
    while True:
        open_cells = free("row").join(match.select("col"), "col", "left_anti")
        asked = open_cells.groupBy("col").agg(F.min_by("row", F.xxhash64("row", "col")).alias("row"))
        fresh = scratch.save(asked.groupBy("row").agg(F.min("col").alias("col")), "fresh")
        if fresh.isEmpty():
            break
        match = scratch.save(match.unionByName(fresh), "match")
    while True:
        # by: the column from which a row was reached; root: the unmatched column whose tree it is in
        edge = scratch.save(cells.select("col").distinct().join(match.select("col"), "col", "left_anti").select("col", F.col("col").alias("root")), "layer")
        seen: list[DataFrame] = []
        ends = None
        while not edge.isEmpty():
            reached = cells.join(edge, "col")
            if seen:
                reached = reached.join(_union(seen).select("row"), "row", "left_anti")
            layer = scratch.save(reached.groupBy("row").agg(F.min(F.struct("root", "col")).alias("m")).select("row", F.col("m.col").alias("by"), F.col("m.root").alias("root")), "layer")
            seen.append(layer)
            ends = scratch.save(layer.join(match.select("row"), "row", "left_anti"), "ends")
            if not ends.isEmpty():
                break
            edge = scratch.save(layer.join(match, "row").select("col", "root"), "layer")
        if ends is None or ends.isEmpty():
            return match
        at = ends.groupBy("root").agg(F.min("row").alias("row"))
        tree, turned = _union(seen), []
        while True:
            # a row takes the column that reached it; that column's former row goes on, until the root is taken
            step = scratch.save(at.select("row").join(tree, "row").select("row", F.col("by").alias("col"), "root"), "path")
            turned.append(step.select("row", "col"))
            back = step.where("col <> root").select("col", "root").join(match, "col").select("root", "row")
            at = scratch.save(back, "path")
            if at.isEmpty():
                break
        paths = _union(turned)
        match = scratch.save(match.join(paths.select("col"), "col", "left_anti").select("row", "col").unionByName(paths), "match")


def structural_rank(a: Sparse) -> int: return maximum_matching(a).count()


# orderings

def connected_parts(scratch: Scratch, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """row and part (its least row) of the connected parts of a symmetric pattern (row, col): every row takes the least label around it and then, twice, its
    label's label, until no label changes."""
    labels, before = scratch.save(rows.withColumn("part", F.col("row")), "parts"), None
    while True:
        near = edges.join(labels.select(F.col("row").alias("col"), "part"), "col").groupBy("row").agg(F.min("part").alias("near"))
        after = labels.join(near, "row", "left").select("row", F.least("part", F.coalesce("near", "part")).alias("part"))
        for _ in range(2):
            after = scratch.save(after, "parts")
            after = after.join(after.select(F.col("row").alias("part"), F.col("part").alias("up")), "part").select("row", F.col("up").alias("part"))
        after = scratch.save(after, "parts")
        total = after.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
        labels = after
        if total == before:
            return labels
        before = total


def reverse_cuthill_mckee(a: Sparse) -> DataFrame:
    """row and place: the rows of a symmetric pattern by breadth-first levels, reversed, so that cells lie near the diagonal.

    Each connected part starts at a row as far as possible from the rest (found by repeated searches from the farthest row of least degree). Within a level
    rows follow the place of their first neighbour in the level before, then their degree.
    """
    n, spark = _square(a), a.df.sparkSession
    scratch = Scratch(spark)
    edges = scratch.save(_neighbours(a), "edges")
    degree = spark.range(n).select(F.col("id").alias("row")).join(edges.groupBy("row").agg(F.count("*").alias("degree")), "row", "left").fillna(0, ["degree"])
    degree = scratch.save(degree, "degree")

    def search(start: DataFrame) -> tuple[DataFrame, int]:
        """part, row and level of all rows that the start rows (part, row) reach, and the number of levels."""
        edge, found, level = scratch.save(start.withColumn("level", F.lit(0)), "layer"), [], 0
        while not edge.isEmpty():
            found.append(edge)
            met = edges.join(edge.select("part", "row"), "row").select("part", F.col("col").alias("row")).distinct().join(_union(found).select("row"), "row", "left_anti")
            level += 1
            edge = scratch.save(met.select("part", "row", F.lit(level).alias("level")), "layer")
        return scratch.save(_union(found), "levels"), level

    of = connected_parts(scratch, edges, degree.select("row"))
    start = of.join(degree, "row").groupBy("part").agg(F.min_by("row", F.struct("degree", "row")).alias("row"))
    levels, deep = search(start)
    while True:
        last = levels.join(levels.groupBy("part").agg(F.max("level").alias("level")), ["part", "level"]).join(degree, "row")
        further, deeper = search(last.groupBy("part").agg(F.min_by("row", F.struct("degree", "row")).alias("row")))
        if deeper <= deep:
            break
        levels, deep = further, deeper
    # places level by level: parts one after the other, in each by the place of the first neighbour
    placed: list[DataFrame] = []
    for level in range(deep):
        now = levels.where(F.col("level") == level).join(degree, "row")
        if placed:
            before = edges.join(placed[-1].select(F.col("row").alias("col"), F.col("place").alias("p")), "col").groupBy("row").agg(F.min("p").alias("p"))
            now = now.join(before, "row")
        else:
            now = now.withColumn("p", F.lit(0).cast("long"))
        placed.append(scratch.save(ranked(now.select("part", "row", "level", "p", "degree"), ["p", "degree", "row"], "place").select("part", "row", "level", "place"), "placed"))
    order = ranked(_union(placed), ["part", "level", "place"], "forward").select("row", "forward")
    return scratch.save(order.select("row", (F.lit(n - 1) - F.col("forward")).alias("place")), "order")


def bandwidth(a: Sparse) -> int: return a.df.where("v <> 0").agg(F.coalesce(F.max(F.abs(F.col("row") - F.col("col"))), F.lit(0))).first()[0]
