"""Exact links within large groups of candidates, by blocked sparse products; a group is never expanded into pairs of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, on average, and columns of the dense slices that a product is summed over.
ROWS, COLUMNS = 384, 4096
#: So few pairs of sets are compared one by one.
FEW = 64


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of left's sets with each of right's; sets are arrays of distinct items."""
    if len(left) * len(right) <= FEW:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, item, count = np.unique(np.concatenate([*left, *right]) if len(rows) else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    twice = count[item] > 1
    rows, item = rows[twice], item[twice]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    rows, item = rows[order], item[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
        a, b = np.searchsorted(item, [at, at + COLUMNS])
        part = np.zeros((len(left) + len(right), min(COLUMNS, int(item[-1]) + 1 - at)), np.float32)
        part[rows[a:b], item[a:b] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def link_across(members: DataFrame, to_sets: Callable[[pa.Array], list[np.ndarray]], percent: int, loads: DataFrame) -> DataFrame:
    """Links (a, b) by Jaccard similarity between different components of a group; members: gid, node, component; loads: node, load (what to_sets reads).

    Rows outside a group's largest component meet all rows of it, block by block. A block pair returns the links that
    merge components there, fewer than it has rows; so what comes back is enough for the components and grows with the rows.
    """
    sizes = members.groupBy("gid", "component").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("gid").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    groups = groups.select("gid", "main", F.ceil(F.col("n") / ROWS).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("most")) / ROWS).cast("int").alias("few_blocks"))
    rows = members.join(groups, "gid").join(loads, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.where("component <> main").select("gid", block("few_blocks").alias("p"), spread("all_blocks").alias("q"), F.lit(True).alias("few"), "node", "component", "load")
    every = rows.select("gid", spread("few_blocks").alias("p"), block("all_blocks").alias("q"), F.lit(False).alias("few"), "node", "component", "load")
    cells = few.unionByName(every).groupBy("gid", "p", "q").agg(F.collect_list(F.struct("few", "node", "component", "load")).alias("l")).select("l")

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            few, node, component = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("few", "node", "component"))
            for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
                if few[a:b].all() or not few[a:b].any():
                    continue
                sets = to_sets(flat.field("load").slice(a, b - a))
                size = np.array([len(s) for s in sets])
                left, right = np.flatnonzero(few[a:b]), np.flatnonzero(~few[a:b])
                common = overlaps([sets[i] for i in left], [sets[i] for i in right])
                hit = 100 * common >= percent * (size[left][:, None] + size[right][None] - common)
                hit &= (component[a:b][left][:, None] != component[a:b][right][None]) & (common > 0)
                root = {}

                def find(c, root=root):
                    while (up := root.setdefault(c, c)) != c:
                        root[c] = c = root[up]
                    return c

                links = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                    x, y = find(int(component[a + left[i]])), find(int(component[a + right[j]]))
                    if x != y:
                        root[x] = y
                        links.append((int(node[a + left[i]]), int(node[a + right[j]])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")
