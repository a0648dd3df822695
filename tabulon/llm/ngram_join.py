"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The n-grams (columns) are dealt into blocks by hash. Every task over texts emits one cell per block, a packed piece of the incidence
matrix, so the shuffle moves packed integers and not rows. The join is exact up to 64-bit hashing:

1. `digest`: each text's shingle set, its size and a set id. Equal sets form one class; classes are what is joined.
2. `frequent`: a first product with a vector of ones gives every n-gram's document frequency. Frequent n-grams come last in the order.
3. `prefixes`: two sets with Jaccard >= t share an n-gram among the first n - ceil(t n) + 1 of each in any common order, so only these are multiplied.
4. In a block, the rare n-grams' products are summed per pair of classes; a pair goes on if the sum reaches the bound that both sizes imply.
   A frequent n-gram can still be in a prefix, where a text is made of little else. Its classes meet the least one of similar size first, and
   groups that hang together so are compared across the components found, block by block: pairs within a component can't change the result.
5. Candidates are verified on their whole sets, and the verified links' components are found by contraction.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import blocks as blocks_
from tabulon.llm import graph, textkernels
from tabulon.llm.common import Scratch, checked_broadcast, documents, partitions

WIDTH, PERCENT = 5, 75
#: N-grams of a block, on average; a block's cells are taken together by one task.
BLOCK = 4_000_000
#: From this document frequency on, an n-gram counts as frequent.
FREQUENT = 64
#: Frequent n-grams that a task may hold (8 bytes each); beyond it the frequency that counts is raised. Only speed depends on it.
FREQUENT_MOST = 2_000_000
#: Bytes of an n-gram's hash that the frequency count keeps.
SHORT = 5


def _ceil_share(n, percent):
    return -(-n * percent // 100)


def _set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key, n_shingles and set_id (null for an empty set) of each row of docs (doc_id, key, text)."""

    def run(batches):
        for batch in batches:
            sizes, sets = np.zeros(len(batch), np.int64), [None] * len(batch)
            for row, s in textkernels.shingle_sets(batch.column(2), width):
                sizes[row] = len(s)
                sets[row] = _set_id(s) if len(s) else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(sets, pa.int64())], ["doc_id", "key", "n_shingles", "set_id"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n_shingles long, set_id long")


def _cells(blocks: np.ndarray, rows: np.ndarray):
    """(block, packed rows of it) for rows whose blocks are given."""
    order = np.argsort(blocks, kind="stable")
    blocks, rows = blocks[order], rows[order]
    at = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.empty(0, int)
    for a, b in zip(at, [*at[1:], len(blocks)], strict=True):
        yield int(blocks[a]), rows[a:b].tobytes()


def _emit(cells: dict[int, list[bytes]], names):
    yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), pa.array([b"".join(x) for x in cells.values()], pa.large_binary()).cast(pa.binary())], names)


#: Packed bytes that a task gathers before it emits its cells.
CELLS = 48 << 20


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(blocks)).astype(np.int32)


def frequent(docs: DataFrame, blocks: int, width: int = WIDTH, least: int = FREQUENT) -> DataFrame:
    """h and df of the n-grams (their lowest SHORT bytes) that at least `least` documents have."""

    def cells(batches):
        held, size = {}, 0
        for batch in batches:
            gathered = []
            for _, s in textkernels.shingle_sets(batch.column(0), width):
                gathered.append(s)
                size += len(s) * SHORT
                if len(gathered) >= 256:
                    h = np.concatenate(gathered)
                    for block, packed in _cells(_block_of(h, blocks), h.view(np.uint8).reshape(-1, 8)[:, :SHORT]):
                        held.setdefault(block, []).append(packed)
                    gathered = []
                if size >= CELLS:
                    yield from _emit(held, ["block", "cell"])
                    held, size = {}, 0
            if gathered:
                h = np.concatenate(gathered)
                for block, packed in _cells(_block_of(h, blocks), h.view(np.uint8).reshape(-1, 8)[:, :SHORT]):
                    held.setdefault(block, []).append(packed)
        if held:
            yield from _emit(held, ["block", "cell"])

    def count(batches):
        cells = {}
        for batch in batches:
            for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells.setdefault(block, []).append(np.frombuffer(cell.as_buffer(), np.uint8))
        for block in list(cells):
            packed = np.concatenate(cells.pop(block)).reshape(-1, SHORT)
            h = np.zeros((len(packed), 8), np.uint8)
            h[:, :SHORT] = packed
            h = np.sort(h.view(np.uint64).ravel())
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[at, len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h[at][n >= least].astype(np.int64)), pa.array(n[n >= least].astype(np.int64))], ["h", "df"])

    return docs.select("text").mapInArrow(cells, "block int, cell binary").repartition(blocks, "block").mapInArrow(count, "h long, df long")


#: A class's entry in a cell is a head (set id, size, slack, n-grams that follow) and then the n-grams; a frequent one has its top bit set.
_HEAD = np.dtype([("set", "<i8"), ("n", "<u4"), ("slack", "<u4"), ("count", "<u4")])


def prefixes(docs: DataFrame, blocks: int, common, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Cells (block, cell) of the prefixes' incidence; `common` is the broadcast pair of arrays of the frequent n-grams, sorted, and their frequencies.

    The order of n-grams is: rare ones by hash, then frequent ones from the least frequent on.
    """
    mask, flag = np.uint64((1 << 8 * SHORT) - 1), np.uint64(1 << 63)

    def run(batches):
        table, df = common.value
        held, size = {}, 0
        for batch in batches:
            for _, s in textkernels.shingle_sets(batch.column(0), width):
                n = len(s)
                if not n:
                    continue
                short = s & mask
                at = np.searchsorted(table, short)
                often = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == short) if len(table) else np.zeros(n, bool)
                length = n - _ceil_share(n, percent) + 1
                rare = s[~often][:length]
                late = s[often]
                if len(rare) < length:
                    late = late[np.lexsort((late, df[at[often]]))][: length - len(rare)]
                else:
                    late = late[:0]
                head = np.zeros(1, _HEAD)
                head["set"], head["n"], head["slack"] = _set_id(s), n, n - length + len(late)
                h = np.concatenate([rare & ~flag, late | flag])
                by = _block_of(h & ~flag, blocks)
                order = np.argsort(by, kind="stable")
                by, h = by[order], h[order]
                cut = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True):
                    head["count"] = b - a
                    held.setdefault(int(by[a]), []).append(head.tobytes() + h[a:b].tobytes())
                    size += 20 + 8 * (b - a)
                if size >= CELLS:
                    yield from _emit(held, ["block", "cell"])
                    held, size = {}, 0
        if held:
            yield from _emit(held, ["block", "cell"])

    return docs.select("text").mapInArrow(run, "block int, cell binary")


def _entries(cells: list[np.ndarray]):
    """The n-gram, set, size and slack of every entry of a block's cells, each (n-gram, set) once, by n-gram and size."""
    heads, grams = [], []
    for cell in cells:
        at, end = 0, len(cell)
        raw = cell.tobytes()
        while at < end:
            count = int.from_bytes(raw[at + 16 : at + 20], "little")
            heads.append(raw[at : at + 20])
            grams.append(raw[at + 20 : at + 20 + 8 * count])
            at += 20 + 8 * count
    head = np.frombuffer(b"".join(heads), _HEAD)
    h = np.frombuffer(b"".join(grams), np.uint64)
    who = np.repeat(np.arange(len(head)), head["count"])
    # an n-gram that only one class has takes no further part
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    same = h[1:] == h[:-1]
    h, who = h[m := np.r_[same, False] | np.r_[False, same]], who[m]
    order = np.lexsort((head["set"][who], head["n"][who], h))
    h, who = h[order], who[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (head["set"][who[1:]] != head["set"][who[:-1]])] if len(h) else np.empty(0, bool)
    h, who = h[fresh], who[fresh]
    return h, head["set"][who], head["n"][who].astype(np.int64), head["slack"][who].astype(np.int64)


def multiply(cells: DataFrame, blocks: int, percent: int = PERCENT) -> DataFrame:
    """Of each block: rare n-grams' pair sums (kind 0: a, b, their sizes and slacks, overlap), and frequent n-grams' classes (kind 1: a = n-gram, b = set, na = size, sa = frequent n-grams that the set has)."""
    names = ["kind", "a", "b", "na", "nb", "sa", "sb", "overlap"]

    def out(kind, *columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32))] + [pa.array(np.asarray(c).astype(np.int64)) for c in columns], names)

    def run(batches):
        cells = {}
        for batch in batches:
            for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells.setdefault(block, []).append(np.frombuffer(cell.as_buffer(), np.uint8))
        for block in list(cells):
            h, sets, n, slack = _entries(cells.pop(block))
            often = h >> np.uint64(63) == 1
            zero = np.zeros(int(often.sum()), np.int64)
            if often.any():
                yield out(1, h[often].view(np.int64), sets[often], n[often], zero, slack[often], zero, zero)
            h, sets, n, slack = (x[~often] for x in (h, sets, n, slack))
            if not len(h):
                continue
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            runs = np.repeat(np.r_[at[1:], len(h)], np.diff(np.r_[at, len(h)]))
            # row i meets the rows behind it in its run, one distance at a time; fewer than FREQUENT distances as a rare n-gram has fewer documents
            pairs, gap, i = [], 1, np.arange(len(h))
            while len(i := i[i + gap < runs[i]]):
                i = i[100 * n[i] >= percent * n[i + gap]]
                pairs.append(np.stack([i, i + gap], 1))
                gap += 1
            p = np.concatenate(pairs) if pairs else np.empty((0, 2), int)
            swap = sets[p[:, 0]] > sets[p[:, 1]]
            p[swap] = p[swap][:, ::-1]
            a, b = sets[p[:, 0]], sets[p[:, 1]]
            order = np.lexsort((b, a))
            p, a, b = p[order], a[order], b[order]
            if len(p):
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                q = p[first]
                yield out(0, a[first], b[first], n[q[:, 0]], n[q[:, 1]], slack[q[:, 0]], slack[q[:, 1]], np.diff(np.r_[first, len(p)]))

    return cells.repartition(blocks, "block").mapInArrow(run, "kind int, a long, b long, na long, nb long, sa long, sb long, overlap long")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame:
    """set_id and grams (packed) of the classes in wanted (set_id). classes: set_id and the key of a text that has it."""

    def sets(batches):
        for batch in batches:
            ids, blobs = [], []
            for _, s in textkernels.shingle_sets(batch.column(0), width):
                ids.append(_set_id(s))
                blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["set_id", "grams"])

    reps = wanted.distinct().join(classes, "set_id").select("key")
    texts = docs.select("key", "text").join(checked_broadcast(reps), "key", "left_semi").select("text")
    return texts.mapInArrow(sets, "set_id long, grams binary").dropDuplicates(["set_id"])


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b: set ids) whose whole sets reach the similarity."""

    def judge(batches):
        for batch in batches:
            ok = []
            for x, y in zip(*map(_unpack, batch.columns[2:]), strict=True):
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    left, right = (sets.select(F.col("set_id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(judge, "a long, b long")


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, set_id, component_id of every row of docs; two rows are linked when 100 * |A and B| >= percent * |A or B| of their shingle sets.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered. Fewer words than `width`: the whole sequence is the one shingle. No words or null
    text: an empty set, linked with nothing, component_id = doc_id. Rows without doc_id are linked like others; a component of such rows alone has a null
    component_id. Equal rows: one class, every row is returned. Other columns are ignored. Empty input: no rows. key is text_key(); set_id
    is the least one of the component (null for an empty set), so it names a group whatever its doc_ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    base = scratch.save(digest(docs, width), "digest")
    classes = base.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"))
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = partitions(spark, total, BLOCK)
    often = scratch.save(frequent(docs, blocks, width), "frequent")
    least = FREQUENT
    while (many := often.where(F.col("df") >= least).count()) > FREQUENT_MOST:
        least *= 2
    table = often.where(F.col("df") >= least).select("h", "df").toArrow()
    table, df = table.column("h").to_numpy().astype(np.uint64), table.column("df").to_numpy()
    order = np.argsort(table)
    common = spark.sparkContext.broadcast((table[order], df[order]))
    product = scratch.save(multiply(prefixes(docs, blocks, common, width, percent), blocks, percent), "product")
    sums = product.where("kind = 0").groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("na", "nb", "sa", "sb")), F.sum("overlap").alias("overlap"))
    # |A and B| >= percent / (100 + percent) * (|A| + |B|), and what the prefixes don't show is at most the larger slack
    candidates = sums.where(f"(overlap + greatest(sa, sb)) * {100 + percent} >= {percent} * (na + nb)").select("a", "b")
    shared = product.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("set"), F.col("na").alias("n"), F.col("sa").alias("frequent"))
    # where frequent n-grams are in a prefix all rare ones are too, so a pair without a common rare one overlaps in frequent ones at most
    stars = shared.join(shared.groupBy("gram").agg(F.min("set").alias("lead")), "gram").where("set <> lead").select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b"))
    stars = scratch.save(stars.distinct(), "stars")
    first = scratch.save(candidates.unionByName(stars).distinct(), "candidates")
    sets = scratch.save(sets_of(docs, first.select(F.explode(F.array("a", "b")).alias("set_id")), classes, width), "sets")
    links = scratch.save(verify(first, sets, percent), "links")
    if not stars.isEmpty():
        groups = graph.components(scratch, stars).select(F.col("node").alias("set_id"), F.col("component").alias("gid"))
        found = graph.components(scratch, links).select(F.col("node").alias("set_id"), "component")
        members = groups.join(found, "set_id", "left").select("gid", F.col("set_id").alias("node"), F.coalesce("component", "set_id").alias("component"))
        links = links.unionByName(scratch.save(blocks_.link_across(members, _unpack, percent, sets.select(F.col("set_id").alias("node"), F.col("grams").alias("load"))), "links"))
    reps = graph.components(scratch, links)
    labels = classes.join(reps.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component"), "rep")
    least_doc = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = scratch.save(labels.join(least_doc, "component").select("set_id", "component", "component_id"), "labels")
    return base.join(labels, "set_id", "left").select("doc_id", "key", "n_shingles", F.col("component").alias("set_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def text_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows of docs: that of least doc_id (null last); of rows with one doc_id, that of least text_key().

    Rows without words are linked with nothing and all stay. The columns of docs, whatever their names. Empty input: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(ngram_join(docs).where("set_id IS NOT NULL").groupBy("set_id", "doc_id", "key").agg(F.count("*").alias("n")), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = rows.groupBy("set_id").agg(F.min(order).alias("keep"), F.sum("n").alias("m")).where("m > 1")
    # groups of one row need no look; of the others, rows that go, and kept ones that repeat
    found = rows.join(kept, "set_id").select("doc_id", "key", (order == F.col("keep")).alias("stays"), "n").where("NOT stays OR n > 1")
    found = checked_broadcast(scratch.save(found, "found")).alias("f")
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key"))
    all_rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")).alias("r").join(found, same, "left")
    single = all_rows.where("f.key IS NULL").select("row")
    repeated = all_rows.where("f.stays").select("row", F.col("r.doc_id").alias("d"), F.col("r.key").alias("k")).dropDuplicates(["d", "k"]).select("row")
    return single.unionByName(repeated).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
