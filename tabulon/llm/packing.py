"""Packing by cutting-stock column generation.

Documents are tokenized where they lie; whole sequences are cut off, and what is left of each is an item. A linear program over the histogram
of item lengths (in steps of STEP tokens, so it is as small for any corpus) picks patterns of lengths that fill a sequence; a knapsack by dynamic
programming prices new patterns. Patterns are rounded down, the few items left over are packed best-fit, and the pattern table, a few hundred
rows, is joined to documents ranked within their length. STEP documents of one short length are one item, a multiple of STEP without
any rounding; longer ones are rounded up by less than STEP, 6 percent of their length at worst.

Where lengths don't add up to a sequence (all documents a little over half of one) no pattern is full. Documents of patterns that would leave more than
1 - TIGHT empty are cut instead: laid end to end, in the order of class and rank, and cut at the last multiple of CUT tokens of a document before each
LENGTH - CUT tokens, so no cut depends on the one before and a sequence lacks CUT tokens on average. Tokens never move: only (document, place) rows do,
with the checksums up to each place where a document can be cut, from which those of its pieces follow.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, bucket_count, documents, hash_bucket, in_buckets

LENGTH, END_ID, STEP = 4096, 2, 16
#: Words whose ids a task remembers (about 200 MB); beyond it, it starts anew.
REMEMBERED = 1_000_000
#: Marks that are a token run of their own behind a letter or digit.
MARKS = ".,;:!?#$%&*"
#: Columns that enter the linear program at most (its patterns are usable after each), and those that one pricing brings among the first EARLY; later all count.
COLUMNS, TAKEN, EARLY = 6000, 12, 1000
#: The program ends when its sequences are at most so much over the optimum (the best price bounds it).
GAP = 0.005
#: Patterns filled less than this are not used; their documents are cut, at multiples of CUT tokens.
TIGHT, CUT = 0.98, 32
_IDS = [struct.Struct(f"<{n}I") for n in range(32)]
_SEPARATORS = {"\x1c", "\x1d", "\x1e", "\x1f"}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Token ids of words, as little-endian 32-bit bytes, and of whole texts.

    This tokenizer drops white space and never joins words across it, so ids are kept by word. It lowers case first, and marks behind a letter
    or digit are a token run of their own, so a capitalized word or one with a mark is put together from its parts.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder, self.end = Tokenizer.from_file(path), np.array([END_ID], "<u4").tobytes()
        # a byte stands as itself if it prints, else as the next letter from U+0100 on: the usual spelling of byte-level vocabularies
        printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printing]
        self.spelling = {b: 0x100 + i for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.rstrip(MARKS)
        # letters up to U+024F are letters in every version of Unicode; U+0130 is lowered to a letter and a mark, which joins what follows
        if bare and bare != word and bare[-1].isalnum() and bare[-1] < "\u0250" and bare[-1] != "\u0130":
            ids = self[bare] + self[word[len(bare) :]]
        else:
            letters = word.isalpha() and max(word) < "\u0180" and "\u0130" not in word
            lower = word.lower() if letters or word.isascii() and "|" not in word else word
            ids = self[lower] if lower != word else self.look_up(word, letters)
        self[word] = ids
        return ids

    def look_up(self, part: str, letters: bool) -> bytes:
        # a run of letters in lower case, of those that no normalization changes, is one word of the model; anything else takes the whole way
        if letters:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.spelling)
            ids = [t.id for t in self.encoder.model.tokenize(spelled)]
        else:
            ids = self.encoder.encode(part, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if len(ids) >= len(_IDS) else _IDS[len(ids)].pack(*ids)

    def words(self, text: str) -> list[str]:
        # str.split also splits at four control characters that the tokenizer takes as symbols
        if any(c in text for c in _SEPARATORS):
            import regex

            return regex.findall(r"\P{White_Space}+", text)
        return text.split()

    def encode(self, texts: list[str]):
        """The ids of each text, with the end, in order."""
        for text in texts:
            yield b"".join(map(self.__getitem__, self.words(text))) + self.end


_ENCODERS: dict[str, WordIds] = {}


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, doc_tokens, crcs (of each piece of LENGTH ids and of the rest) and marks (of the rest up to each multiple of CUT, unsigned 32-bit little-endian).

    One row for each of docs; a null text is empty, and its one id is END_ID.
    """

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            counts, crcs, marks = [], [], []
            for data in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(data) // 4)
                crcs.append([zlib.crc32(data[a : a + 4 * LENGTH]) for a in range(0, len(data), 4 * LENGTH)])
                marks.append(_marks(data, len(data) - len(data) % (4 * LENGTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "doc_tokens", "crcs", "marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, marks binary")


def _marks(data: bytes, start: int) -> bytes:
    """Checksums of data from `start` up to each multiple of CUT ids below its end."""
    crc, out, step = 0, [], 4 * CUT
    for at in range(start, len(data) - step, step):
        crc = zlib.crc32(data[at : at + step], crc)
        out.append(crc)
    return struct.pack(f"<{len(out)}I", *out)


def _behind(whole: int, before: int, n: int) -> int:
    """The checksum of the last n bytes, from that of everything and that of what is before them."""
    zeros = bytes(n)
    return whole ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def _pieces(batches):
    """Cuts rows (doc_id, doc_tokens, crc of the rest, marks, place of its first id among all that are laid end to end) where sequences end."""
    room = LENGTH - CUT
    for batch in batches:
        out = []
        for doc, tokens, crc, marks, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, at = tokens % LENGTH, 0
            known = (0, *struct.unpack(f"<{len(marks) // 4}I", marks))
            for k in range(place // room, (place + n - 1) // room + 1):
                to = min(n, ((k + 1) * room - place) // CUT * CUT) if (k + 1) * room < place + n else n
                if to > at:
                    upto = crc if to == n else known[to // CUT]
                    out.append((doc, tokens - n + at, to - at, _behind(upto, known[at // CUT], 4 * (to - at)) if at else upto, tokens, k, place))
                    at = to
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The value of the most valuable multiset of sizes within capacity, and up to `most` patterns (a column each) that beat one sequence, each the best one with a certain size in it."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            v = best[c - sizes[:n]] + values[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], k
    # the largest filled room that is not above each one
    filled = np.maximum.accumulate(np.where(pick >= 0, np.arange(capacity + 1), 0))
    columns, worth = [], values + best[capacity - sizes]
    for i in (k for k in np.argsort(-worth, kind="stable")[:most] if worth[k] > 1 + GAP / 4):
        pattern = np.zeros(len(sizes))
        pattern[i] = 1
        c = filled[capacity - sizes[i]]
        while c > 0:
            pattern[pick[c]] += 1
            c = filled[c - sizes[pick[c]]]
        columns.append(pattern)
    return best[capacity], np.unique(np.array(columns).reshape(-1, len(sizes)), axis=0).T


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items by size, sequences) that hold `demand` items of each size, with nearly as few sequences as possible."""
    if not demand:
        return []
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    turn = 0
    while turn < COLUMNS:
        value, columns = _price(sizes, np.maximum(inverse.sum(0), 0), capacity, TAKEN if turn < EARLY else m)
        if value <= 1 + GAP or not columns.size:
            break
        # what one pricing found enters until the prices that follow want none of it
        before = turn
        while turn < COLUMNS:
            prices = inverse.sum(0) @ columns
            best = int(prices.argmax())
            if prices[best] <= 1 + GAP / 4:
                break
            column = columns[:, best]
            step = inverse @ column
            up = step > 1e-9
            if not up.any():
                break
            ratio = np.full(m, np.inf)
            ratio[up] = x[up] / step[up]
            r = int(ratio.argmin())
            x = x - ratio[r] * step
            x[r] = ratio[r]
            basis[:, r] = column
            turn += 1
            if turn % 50 == 0:
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ need, 0)
            else:
                inverse[r] /= step[r]
                others = np.arange(m) != r
                inverse[others] -= np.outer(step[others], inverse[r])
        if turn == before:
            break
    out, left = [], need.astype(int).copy()
    for k in np.argsort(-x):
        column = basis[:, k].astype(int)
        used = column > 0
        times = min(int(x[k] + 1e-6), int((left[used] // column[used]).min()))
        if times > 0:
            out.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
            left -= times * column
    # rounding leaves a few items of each size: fill one sequence at a time, largest first, as often as it repeats
    while left.any():
        room, pattern = capacity, {}
        for i in range(m - 1, -1, -1):
            if k := min(int(left[i]), room // int(sizes[i])):
                pattern[int(sizes[i])] = k
                room -= k * int(sizes[i])
        times = min(int(left[i]) // pattern[int(sizes[i])] for i in range(m) if int(sizes[i]) in pattern)
        out.append((pattern, times))
        for i in range(m):
            left[i] -= times * pattern.get(int(sizes[i]), 0)
    return out


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all rows of docs in sequences of at most LENGTH tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row, with null or empty text too, has its END_ID and so a piece. Pieces of a sequence lie one behind another from 0. Rows with equal
    doc_id are separate documents, told apart by nothing but their pieces; equal ones are interchangeable. Empty input: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rest = F.col("doc_tokens") % LENGTH
    # a class for each short length, and one for each step of the others; 0: nothing is left
    size_class = F.when(rest < LENGTH // STEP, rest).otherwise(LENGTH + F.ceil(rest / STEP)).cast("int")
    rows = scratch.save(tokenized(docs, path or tokenizer_path()).withColumn("class", size_class), "tokens")
    rows_n = rows.count()
    b = bucket_count(rows_n)
    order = ["doc_id", "doc_tokens", "crcs"]
    ranked = scratch.save(in_buckets(rows, ["class"], hash_bucket(b, "doc_id", "crcs"), order, "rank"), "ranked")
    stats = ranked.groupBy("class").agg(F.count("*").alias("n"), F.max("doc_tokens").alias("most"), F.sum(rest).alias("tokens")).orderBy("class").collect()  # LENGTH / STEP rows of either sort at most
    demand: dict[int, int] = {}
    tokens: dict[int, float] = {}
    classes, first = [], 0
    for r in stats:
        bundles, single = r["n"] // STEP if r["class"] < LENGTH else 0, -(-r["class"] // STEP) if r["class"] < LENGTH else r["class"] - LENGTH
        begin = []
        for size, n, documents in ((r["class"], bundles, STEP), (single, r["n"] - STEP * bundles, 1)):
            begin.append(demand.get(size, 0))
            if r["class"] and n:
                demand[size] = begin[-1] + n
                tokens[size] = tokens.get(size, 0) + n * documents * r["tokens"] / r["n"]
        if single == r["class"] and bundles:  # both sorts of items are of one size
            begin[1] = begin[0] + bundles
        classes.append((r["class"], r["class"], single, bundles, *begin, first))
        first += r["n"]
    table, sequence, begun = [], 0, dict.fromkeys(demand, 0)
    for pattern, times in patterns(demand, LENGTH // STEP):
        if sum(k * tokens[size] / demand[size] for size, k in pattern.items()) < TIGHT * LENGTH:
            continue
        for size, k in pattern.items():
            table.append((size, begun[size], begun[size] + k * times, k, sequence))
            begun[size] += k * times
        sequence += times
    whole = max((r["most"] // LENGTH for r in stats), default=0)
    plan = spark.createDataFrame(table, "size int, a long, z long, k long, base long")
    classes = spark.createDataFrame(classes, "class int, many int, single int, bundles long, of_many long, of_single long, first long")
    placed = ranked.join(F.broadcast(classes), "class")
    bundled = F.col("rank") < F.col("bundles") * STEP
    items = placed.where("class > 0").withColumn("size", F.when(bundled, F.col("many")).otherwise(F.col("single")))
    items = items.withColumn("item", F.when(bundled, F.expr(f"of_many + rank div {STEP}")).otherwise(F.expr(f"of_single + rank - bundles * {STEP}")))
    place = ["doc_id", F.expr(f"doc_tokens div {LENGTH} * {LENGTH}").alias("start"), rest.alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens"]
    fitted = items.join(F.broadcast(plan), "size").where("item >= a AND item < z")
    fitted = fitted.select(*place, F.expr("base + (item - a) div k").alias("sequence_id"), (-F.col("size")).cast("long").alias("place"), F.expr("(item - a) % k").alias("slot"), "rank")
    # the rest is laid end to end: places within (class, bucket) by a window, those of buckets and classes from their sums
    ends = spark.createDataFrame([(size, n) for size, n in begun.items()], "size int, kept long")
    loose = items.join(F.broadcast(ends), "size").where("item >= kept").withColumn("bucket", F.expr(f"rank div {max(1, rows_n // 65_536, 1000)}"))
    loose = loose.select("class", "bucket", "rank", "doc_id", "doc_tokens", F.element_at("crcs", -1).alias("crc"), "marks", rest.alias("n"))
    sums = scratch.save(loose.groupBy("class", "bucket").agg(F.sum("n").alias("n")), "sums")
    total, begins = 0, []
    for r in sums.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect():
        begins.append((r["class"], total))
        total += r["n"]
    until = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    until = until.join(F.broadcast(spark.createDataFrame(begins, "class int, begin long")), "class")
    within = W.partitionBy("class", "bucket").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    loose = loose.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(until, ["class", "bucket"])
    cut = loose.select("doc_id", "doc_tokens", "crc", "marks", F.expr("begin + before + within").alias("place"))
    cut = cut.mapInArrow(_pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    cut = cut.withColumn("sequence_id", F.col("sequence_id") + sequence).select("*", F.lit(0).cast("long").alias("slot"), F.col("start").alias("rank"))
    sequence += total // (LENGTH - CUT) + 1
    before = W.partitionBy("sequence_id").orderBy("place", "slot", "rank").rowsBetween(W.unboundedPreceding, -1)
    items = fitted.unionByName(cut).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    full = placed.where(f"doc_tokens >= {LENGTH}").select("doc_id", "doc_tokens", F.expr(f"{sequence}L + (first + rank) * {whole}L").alias("base"), F.posexplode(F.expr(f"slice(crcs, 1, int(doc_tokens div {LENGTH}))")).alias("j", "ids_crc32"))
    full = full.select("doc_id", F.expr(f"j * {LENGTH}L").alias("start"), F.lit(LENGTH).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return items.select(*full.columns).unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
