"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard verification, components; one line of each stays.

A line's signature comes from one permutation: the hash of every shingle falls into one of BINS and each bin keeps its least. An empty bin takes the
value of the first filled one in an order of its own (BORROW), so that bins agree independently of each other however few shingles a line has.
BANDS bands of ROWS bins put lines with a similarity of 0.75 together with probability 1 - (1 - 0.75**4)**16 = 0.998, of 0.8 with 0.9998; shingles
of a line that fall into one bin change this by a few thousandths (tests/llm measures it by line length).
The lines of a bucket are paired with its least one, its lead, if their sketches agree; those that don't clearly agree go on to the next lead among
themselves. Tasks do so with what they have gathered before anything is shuffled, so a bucket that many lines share leaves each task as its leads.
All pairs are verified, and lines of one lead that are then in different components are compared in blocks: no bucket is capped, no group is
expanded into all its pairs, and lines that merely hang together through others are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import blocks, graph, textkernels
from tabulon.llm.common import Scratch, checked_broadcast, documents, partitions

SHINGLE, PERCENT = 5, 75
BINS, BANDS, ROWS = 64, 16, 4
#: Two bits of each of SKETCH bins travel with a line, and how many bins it filled itself, m. Two bits agree with probability J + (1 - J) / 4, so a
#: pair with a similarity of 0.75 agrees in 0.81 of the bins, with a variance of 0.15 / m; it is paired unless it lies DEVIATIONS below that.
SKETCH, DEVIATIONS = 60, 3.2
#: A line that agrees in so many bins more needs no other lead.
CLEAR = 5
#: Bytes of text handled at once; their arrays fit a processor's cache.
PIECE = 1 << 18
#: Records (bucket, line, sketch) that a task gathers before it pairs and emits them, and those of a task behind the shuffle on average.
GATHERED, PART = 200_000, 500_000
AGREE = np.array([0, *(int(SKETCH * max(0.8125 - DEVIATIONS * (0.1523 / m) ** 0.5, 0)) for m in range(1, BINS + 1))])
#: Where the two bits of a bin lie in their number.
PLACE = np.array([2 * (31 - j) if j < 32 else 2 * (SKETCH - 1 - j) for j in range(SKETCH)], np.uint64)
#: Column b is the order, drawn once, in which bin b looks for a filled one.
BORROW = np.random.default_rng(5).permuted(np.tile(np.arange(BINS)[:, None], (1, BINS)), axis=0)


def signatures(shingles: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x BANDS band hashes, and two numbers with two bits of each of SKETCH bins and the count of filled bins.

    owner tells each shingle's line; all of 0 to n - 1 occur, and what belongs to no line has owner n.
    """
    empty = np.uint32(0xFFFFFFFF)
    least = np.full((n + 1) * BINS, empty)
    cell = (shingles >> np.uint64(58)).view(np.int64)
    cell += owner * BINS
    np.minimum.at(least, cell, (shingles >> np.uint64(26)).astype(np.uint32))
    least = least[: n * BINS]
    hollow = least == empty
    at = np.flatnonzero(hollow)
    for step in BORROW:
        if not len(at):
            break
        source = at - at % BINS + step[at % BINS]
        found = ~hollow[source]
        least[at[found]] = least[source[found]]
        at = at[~found]
    by_bin = least.reshape(n, BINS).T.astype(np.uint64, order="C")
    bands = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * textkernels._SLOT[5])[:, None], n, axis=1)
    for j in range(ROWS):
        bands += by_bin[j * BANDS : (j + 1) * BANDS] * textkernels._SLOT[j]
    textkernels.mix(bands)
    bits = by_bin[:SKETCH]
    bits &= np.uint64(3)
    bits <<= PLACE[:, None]
    filled = (BINS - hollow.reshape(n, BINS).sum(1)).astype(np.uint64)
    sketch = np.stack([np.bitwise_or.reduce(bits[:32], 0), (np.bitwise_or.reduce(bits[32:], 0) << np.uint64(8)) | filled], 1)
    return np.ascontiguousarray(bands.T), sketch


def lines_of(column: pa.Array, signed: bool = True, places: bool = False):
    """(text, number of the line in its text, 64-bit hash) of all lines with a word, as arrays, about PIECE bytes of text at a time.

    If signed: (hash, band hashes, sketch) of the different ones instead, or behind these if places are wanted too.
    """
    for row, data, offsets in textkernels.chunks(column, PIECE):
        if not len(data):
            continue
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        total = len(points)
        at = offsets if total == len(data) else offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        breaks = points == 10
        newlines = np.flatnonzero(breaks)
        starts = np.unique(np.concatenate([at[:-1], newlines + 1]))
        starts = starts[starts < total]
        ends = np.r_[starts[1:], total]
        ends = ends - breaks[ends - 1]
        real = np.logical_or.reduceat((points != 0x20) & (points - np.uint32(9) > 4), starts)
        starts, ends = starts[real], ends[real]
        if not len(starts):
            continue
        up, down = textkernels.powers(total)
        wide = points.astype(np.uint64)
        sums = wide + np.uint64(1)
        sums *= up
        np.cumsum(sums, out=sums)
        h = sums[ends - 1]
        h[starts > 0] -= sums[starts[starts > 0] - 1]
        h = textkernels.mix(h * down[starts])
        place = ()
        if places or not signed:
            text = np.searchsorted(at, starts, "right") - 1
            place = row + text, np.searchsorted(newlines, starts) - np.searchsorted(newlines, at[text]), h
        if not signed:
            yield place
            continue
        once = np.sort(np.unique(h, return_index=True)[1])
        h, starts, ends = h[once], starts[once], ends[once]
        s, term = wide.copy(), np.empty(total, np.uint64)  # the last places begin no shingle
        for j in range(1, SHINGLE):
            m = max(total - j, 0)
            s[:m] += np.multiply(wide[j:], textkernels._SLOT[j], out=term[:m])
        textkernels.mix(s)
        tiny = ends - starts < SHINGLE  # the whole line is its one shingle
        s[starts[tiny]] = h[tiny]
        # places of a line's shingles and those behind them take turns
        count = np.maximum(ends - starts - SHINGLE + 1, 1)
        turns = np.stack([count, np.r_[starts[1:], total] - starts - count], 1).ravel()
        owner = np.repeat(np.stack([np.arange(len(starts)), np.full(len(starts), len(starts))], 1).ravel(), turns)
        s = s[starts[0] :]
        yield *place, h, *signatures(s, owner, len(starts))


def _surplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bins more than needed for a pair the sketches (rows of two numbers) agree."""
    z = a ^ b
    z[:, 1] >>= np.uint64(8)
    z |= z >> np.uint64(1)
    filled = np.minimum(a[:, 1] & np.uint64(255), b[:, 1] & np.uint64(255))
    return SKETCH - np.bitwise_count(z & np.uint64(0x5555555555555555)).sum(1).astype(np.int64) - AGREE[filled]


_RECORD = np.dtype([("bucket", "<u8"), ("line", "<i8"), ("sketch", "<u8", 2)])
_PLACE = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("line", "<i8"), ("number", "<i4"), ("none", "?")])


def _pairs(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lead, line) of records that share a bucket and agree, and the records that remain for others to be paired with: each bucket's leads."""
    buckets = np.ascontiguousarray(records["bucket"])
    order = np.argsort(buckets)
    buckets = buckets[order]
    same = buckets[1:] == buckets[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    alone, records = records[order[~shared]], records[order[shared]]
    records = records[np.lexsort((records["line"], records["bucket"]))]
    again = (records["bucket"][1:] == records["bucket"][:-1]) & (records["line"][1:] == records["line"][:-1])
    left = records[~np.r_[False, again]] if len(records) else records
    pairs, leads = [np.empty((0, 2), np.int64)], [alone]
    while len(left):
        b = left["bucket"]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        lead = np.repeat(start, np.diff(np.r_[start, len(left)]))
        like = _surplus(left["sketch"], left["sketch"][lead])
        is_lead = np.arange(len(left)) == lead
        pair = (like >= 0) & ~is_lead
        pairs.append(np.stack([left["line"][lead[pair]], left["line"][pair]], 1))
        leads.append(left[start])
        left = left[(like < CLEAR) & ~is_lead]
    return np.unique(np.concatenate(pairs), axis=0), np.concatenate(leads)


def _lines_and_leads(rows: DataFrame, records: int) -> DataFrame:
    """doc_id, key, number and line (hash) of every line with a word (lead: null), and lead and line (all else null) of lines that share a bucket with a lesser one of similar sketch.

    That one is its lead; a bucket has a lead for each sort of lines. rows: doc_id, key, text; records: about how many there are of (bucket, line).
    They travel packed, and are paired before and behind the shuffle; the places of lines travel with them in even parts, so texts are parsed once.
    """
    parts = partitions(rows.sparkSession, records, PART)
    names = ["doc_id", "key", "number", "line", "lead"]

    def emit(held, places):
        pairs, leads = _pairs(np.concatenate(held))
        cells = {}
        for which, key, packed in ((0, pairs[:, 0].view(np.uint64), pairs), (1, leads["bucket"], leads)):
            block = (key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)  # ranges of keys, which are nearly in order
            order = np.argsort(block, kind="stable")
            block, packed = block[order], packed[order]
            cuts = [0, *np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True) if len(block) else ():
                cells.setdefault(int(block[a]), [b"", b""])[which] = packed[a:z].tobytes()
        spread = [p.tobytes() for p in np.array_split(np.concatenate(places), len(cells))]
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), *(pa.array([c[k] for c in cells.values()], pa.binary()) for k in (0, 1)), pa.array(spread, pa.binary())], ["block", "pairs", "leads", "places"])

    def gather(batches):
        held, places, size = [], [], 0
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_id, key = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for text, number, line, h, bands, sketch in lines_of(batch.column(2), places=True):
                records, place = np.empty(bands.size, _RECORD), np.empty(len(line), _PLACE)
                records["bucket"], records["line"], records["sketch"] = bands.ravel(), np.repeat(h.view(np.int64), BANDS), np.repeat(sketch, BANDS, axis=0)
                place["doc_id"], place["key"], place["line"], place["number"], place["none"] = doc_id[text], key[text], line.view(np.int64), number, none[text]
                held.append(records)
                places.append(place)
                size += len(records) + len(place)
                if size >= GATHERED:
                    yield from emit(held, places)
                    held, places, size = [], [], 0
        if held:
            yield from emit(held, places)

    def of_pairs(pairs):
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(pairs), pa.int32()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names)

    def pair(batches):
        blocks = {}
        for batch in batches:
            cells = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))
            p = np.frombuffer(b"".join(cells["places"]), _PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(p["doc_id"], mask=p["none"]), pa.array(p["key"]), pa.array(p["number"]), pa.array(p["line"]), pa.nulls(len(p), pa.int64())], names)
            yield of_pairs(np.frombuffer(b"".join(cells["pairs"]), np.int64).reshape(-1, 2))
            for block, leads in zip(cells["block"], cells["leads"], strict=True):
                blocks.setdefault(block, []).append(np.frombuffer(leads, _RECORD))
        for block in list(blocks):
            yield of_pairs(_pairs(np.concatenate(blocks.pop(block)))[0])

    packed = rows.select("doc_id", "key", "text").mapInArrow(gather, "block int, pairs binary, leads binary, places binary")
    return packed.repartition(parts, "block").mapInArrow(pair, "doc_id long, key long, number int, line long, lead long")


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The set of SHINGLE characters of each text, or of a shorter text as a whole, as ascending distinct numbers; two are equal if and only if the shingles are."""
    data, offsets = textkernels.text_buffer(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    total = len(points)
    at = offsets if total == len(data) else offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
    starts, sizes = at[:-1].copy(), np.diff(at)
    # short texts once more behind all others, filled with zeros, so that each is a shingle
    short = np.flatnonzero(sizes < SHINGLE)
    inside = np.arange(SHINGLE) < sizes[short][:, None]
    filled = np.zeros(inside.shape, np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    number = np.cumsum(seen, dtype=np.uint64)  # of a character, from 1
    c = number[points]
    filled[inside] = c[(starts[short][:, None] + np.arange(SHINGLE))[inside]]
    starts[short] = total + SHINGLE * np.arange(len(short))
    c = np.concatenate([c, filled.ravel().astype(np.uint64)])
    m = max(len(c) - SHINGLE + 1, 0)
    bits = int(number[-1]).bit_length()
    if bits * SHINGLE <= 64:
        keys = c[:m].copy()
        for j in range(1, SHINGLE):
            keys <<= np.uint64(bits)
            keys |= c[j : j + m]
    else:  # longer and longer beginnings are numbered
        keys = c[:m]
        for j in range(1, SHINGLE):
            keys = np.unique(keys, return_inverse=True)[1].astype(np.uint64) << np.uint64(21) | c[j : j + m]
    out = []
    for a, b in zip(starts.tolist(), (starts + np.maximum(sizes - SHINGLE + 1, 1)).tolist(), strict=True):
        k = np.sort(keys[a:b])
        new = np.empty(len(k), bool)
        new[0] = True
        np.not_equal(k[1:], k[:-1], out=new[1:])
        out.append(k[new])
    return out


def similar(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of lines whose sets of SHINGLE characters have the Jaccard similarity. texts: line and its text."""

    def run(batches):
        for batch in batches:
            ends = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy().astype(np.int64) for k in (2, 3)))
            ok = np.zeros(len(ends), bool)
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                both = pa.concat_arrays([batch.column(k).slice(at, to - at) for k in (2, 3)]).dictionary_encode()
                sets, index = _sets(both.dictionary), both.indices.to_numpy().reshape(2, -1).T.tolist()
                for row, (x, y) in enumerate(index, at):
                    either = np.concatenate((sets[x], sets[y]))
                    either.sort()
                    common = np.count_nonzero(either[1:] == either[:-1])
                    ok[row] = 100 * common >= percent * (len(either) - common)
                at = to
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    left, right = (texts.select(F.col("line").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def find_repeats(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """doc_id, key (hash of doc_id and text), removed (numbers of the lines to remove, from 0, ascending) of documents that lose lines."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text").where("text IS NOT NULL")
    n = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    both = scratch.save(_lines_and_leads(rows, n * BANDS), "lines")
    lines = both.where("number IS NOT NULL").select("doc_id", "key", "number", "line")
    leads = scratch.save(both.where("lead IS NOT NULL").select("lead", "line").distinct(), "leads")
    first = F.min(F.struct("doc_id", "key", "number"))
    paired = scratch.save(leads.select(F.explode(F.array("lead", "line")).alias("line")).distinct(), "paired")
    wanted = lines.join(checked_broadcast(paired), "line", "left_semi").groupBy("line").agg(first.alias("f"))
    by_doc = scratch.save(wanted.groupBy("f.doc_id", "f.key").agg(F.collect_list(F.struct(F.col("f.number").alias("number"), "line")).alias("at")), "places")
    places = by_doc.agg(F.sum(F.size("at"))).first()[0] or 0
    full = rows.alias("r").join(checked_broadcast(by_doc, places).alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.key") == F.col("d.key"))).select(F.split("text", "\n", -1).alias("parts"), F.explode("at").alias("p"))
    texts = scratch.save(full.select("p.line", F.get("parts", "p.number").alias("text")).dropDuplicates(["line"]), "texts")
    links = scratch.save(similar(leads.select(F.col("lead").alias("a"), F.col("line").alias("b")), texts), "links")
    found = graph.components(scratch, links).select(F.col("node").alias("line"), "component")
    # a lead of one line is settled; of more, those that it isn't linked with may be linked with each other
    many = leads.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1").select("lead")
    stars = leads.join(many, "lead", "left_semi").unionByName(many.select("lead", F.col("lead").alias("line")))
    members = stars.join(found, "line", "left").select(F.col("lead").alias("gid"), F.col("line").alias("node"), F.coalesce("component", "line").alias("component"))
    links = links.unionByName(scratch.save(blocks.link_across(members, _sets, PERCENT, texts.select(F.col("line").alias("node"), F.col("text").alias("load"))), "links"))
    labels = graph.components(scratch, links).select(F.col("node").alias("line"), F.col("component"))
    # each line's first place and number of places, before components are looked at: a line that all documents hold is one row here
    each = lines.groupBy("line").agg(first.alias("f"), F.count("*").alias("n")).join(labels, "line", "left").where("n > 1 OR component IS NOT NULL")
    each = scratch.save(each.select("line", F.coalesce("component", "line").alias("component"), "f", "n"), "each")
    kept = each.groupBy("component").agg(F.min("f").alias("keep"), F.sum("n").alias("m")).where("m > 1")
    repeated = scratch.save(each.select("line", "component").join(kept.select("component", "keep"), "component").select("line", "keep"), "repeated")
    gone = lines.join(checked_broadcast(repeated), "line").where(~F.struct("doc_id", "key", "number").eqNullSafe(F.col("keep")))
    removed = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("number")).alias("removed"))
    return removed, scratch


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated lines: of lines linked by a Jaccard similarity of 0.75 of their 5-character shingles, only the first stays.

    First by doc_id (null before all others), then place. Lines without a word stay and are never compared; a line of fewer than 5 characters
    equals only itself. Rows with equal doc_id and text are treated alike. Documents that lose all their words go; a null or blank text
    stays as it is. n_chars is renewed if docs has it; all other columns, whatever their names, pass through.
    """
    removed, _ = find_repeats(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("k"))
    joined = rows.join(removed, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left")
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    out = joined.select("row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left).alias("t"), F.col("removed").isNotNull().alias("cut"))
    out = out.where("NOT cut OR t RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    fields = [F.col("t").alias(c) if c == "text" else F.length("t").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and removed (their numbers, comma-joined) of every document."""
    docs = documents(spark, sf_dir)
    removed, _ = find_repeats(docs)
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), lines.cast("long").alias("n_lines"))
    found = rows.alias("r").join(removed.alias("x"), F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.key") == F.col("x.key")), "left")
    return found.select("r.doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))
