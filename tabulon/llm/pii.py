"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans seed the bootstrap. Its instances are identifier-shaped spans of one or more words: words with a digit or an at sign, joined to
further words with digits behind single spaces ('+44 20 7946 0958', 'DE89 3704 0044 0532 0130 00', '030-5550001'), and mail addresses written with
(at). The one and the two words before the whole span and the word behind it are its lexical patterns. A pattern's confidence is the sum of the scores of
the instances seen in it over all occurrences of its words in all documents and one more; an instance's score is 1 for a seed and else the best
confidence of its patterns. Rounds of these two sums over the pattern-instance graph are joins and aggregates. In every round each pattern with enough
distinct trusted instances takes part, whether seeds or found by then; all occurrences of trusted instances become spans (kind ctx_<kind of the
seeds>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import spans
from tabulon.llm.common import BLANK, Scratch, checked_broadcast, documents

_LOCAL = "A-Za-z0-9._%+-"
# The forms below match what the plain forms match, at the same places: possessive runs that start at a run's first character (or where the
# last match ended) keep a long run from being searched once per character, and groups repeat possessively, which takes no stack: no text is too long.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: What stands between card numbers: anything but single separators between digits.
NOT_CARD = r"[^0-9]{2,}+|[^0-9\x20-]|\A[\x20-]|[\x20-]\z"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_BLANKS = " \t\n\x0b\x0c\r"
_X = r"\x20\x09-\x0D"
#: Words with a digit or an at sign, from a word's start, with the words with digits that follow behind single spaces; and addresses written with (at).
MAIL = rf"[^{_X}(\[]++\x20?[(\[](?i:at)[)\]]\x20?[^{_X}]++(?:\x20[(\[](?i:dot)[)\]]\x20[^{_X}]++)*+"
SHAPED = rf"(?<![^{_X}])(?:{MAIL}|[^{_X}0-9@]*+[0-9@][^{_X}]*+(?:\x20[^{_X}0-9]*+[0-9][^{_X}]*+)*+)"
AT = r"(?i)[(\[]at[)\]]"
ROUNDS, CONFIDENCE, SEEDS = 4, 0.6, 3
#: Digits that an instance without an at sign has at least.
DIGITS = 5


def _ip_ok(hit: Column, _: Column) -> Column:
    return ~hit.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def _card_ok(hit: Column, _: Column) -> Column:
    d = spans.digits(hit)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", F.when(F.length(d).between(12, 19), d).otherwise("0"))


def _phone_ok(hit: Column, _: Column) -> Column:
    return F.length(spans.digits(hit)).between(9, 15)


def _cards(text: Column) -> Column:
    """Digit runs with single separators are what is left when the text is split at everything else."""
    runs = F.split(text, NOT_CARD, -1)
    others = F.regexp_extract_all(text, F.lit(NOT_CARD), 0)
    empty = F.array().cast(spans.SPAN)

    def items(row, at):
        span = F.struct(at.alias("start"), (at + F.length(row["run"])).alias("stop"), row["run"].alias("hit"), row["run"].alias("part"))
        return F.when(_card_ok(row["run"], row["run"]), F.array(span)).otherwise(empty)

    rows = F.arrays_zip(runs.alias("run"), others.alias("other"))
    placed = spans.placed(rows, lambda row: F.length(row["run"]) + F.coalesce(F.length(row["other"]), F.lit(0)), items)
    return F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), placed).otherwise(empty)


def base_spans(text: Column) -> list[tuple[str, Column]]:
    """Each kind's spans in `text` (not null)."""
    always = lambda hit, part: F.lit(True)
    return [("email", spans.matches(text, EMAIL, always, gate="@")), ("ip", spans.matches(text, IP, _ip_ok)), ("card", _cards(text)), ("phone", spans.matches(text, PHONE, _phone_ok, gate=r"\+[0-9]"))]


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[.,;!?\"')\]]+\z", ""))


def _shaped(text: Column) -> Column:
    """Identifier-shaped spans with their places and neighbouring words: array of (start, stop, word, left, left2, right)."""
    kind = "array<struct<start:bigint,stop:bigint,word:string,left:string,left2:string,right:string>>"
    gaps = F.split(text, SHAPED, -1)
    words = F.regexp_extract_all(text, F.lit(SHAPED), 0)
    after = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    rows = F.arrays_zip(gaps.alias("gap"), words.alias("word"), after.alias("after"))

    def item(row, at):
        before = F.reverse(F.split(F.btrim(row["gap"], F.lit(_BLANKS)), BLANK + "+"))
        left, second = _bare(F.get(before, F.lit(0))), _bare(F.get(before, F.lit(1)))
        left2 = F.when(second != "", F.concat_ws(" ", second, left)).otherwise("")
        right = _bare(F.regexp_extract(row["after"], rf"\A{BLANK}+([^\x20\x09-\x0D]+)", 1))
        lead = F.length(F.regexp_extract(row["word"], r"\A[(\[\"'<]*", 0))
        core = F.regexp_extract(row["word"], r"\A[(\[\"'<]*(.*?)[)\]\"'>.,;:!?]*\z", 1)
        return F.struct((at + lead).cast("long").alias("start"), (at + lead + F.length(core)).cast("long").alias("stop"), core.alias("word"), left.alias("left"), left2.alias("left2"), right.alias("right"))

    def items(row, at):
        return F.when(row["word"].isNotNull() & ok(row["word"]), F.array(item(row, at + F.length(row["gap"])))).otherwise(F.array().cast(kind))

    ok = lambda w: w.contains("@") | w.rlike(AT) | (F.length(spans.digits(w)) >= DIGITS)
    found = spans.placed(rows, lambda row: F.length(row["gap"]) + F.coalesce(F.length(row["word"]), F.lit(0)), items)
    return F.when(text.rlike(rf"@|[0-9](?:[^0-9]{{0,6}}[0-9]){{{DIGITS - 1}}}|{AT}"), found).otherwise(F.array().cast(kind))


def _seeded(shaped: Column, kinds: dict[str, Column]) -> Column:
    """shaped with kind: that of the base spans which a shaped span overlaps, the first in order if several do, else null.

    Shaped spans are compared in runs, each with the base spans between its ends.
    """
    names = ("start", "stop", "word", "left", "left2", "right")

    def kind(i, near):
        of = F.lit(None).cast("string")
        for k, name in reversed(list(enumerate(kinds))):
            of = F.when(F.exists(F.get(near, F.lit(k)), lambda s: (s["start"] < i["stop"]) & (s["stop"] > i["start"])), F.lit(name)).otherwise(of)
        return of

    def tagged(run):
        first, last = F.get(run, F.lit(0))["start"], F.get(run, F.size(run) - 1)["stop"]
        near = F.array(*(F.filter(c, lambda s: (s["start"] < last) & (s["stop"] > first)) for c in kinds.values()))
        return F.get(F.transform(F.array(near), lambda n: F.transform(run, lambda i: F.struct(*(i[c].alias(c) for c in names), kind(i, n).alias("kind")))), F.lit(0))

    return F.flatten(F.transform(spans.runs(shaped), tagged))


def _patterns(rows: DataFrame, *columns: str) -> DataFrame:
    """columns and each pattern (side, near) of the rows' left, left2 and right."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("near")) for side in ("left", "left2", "right")))
    return rows.select(*columns, F.explode(sides).alias("p")).select(*columns, "p.side", "p.near").where("near <> ''")


def pattern_totals(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (side, near) with total, the occurrences of the pattern's words over all of texts (text)."""
    words = F.transform(F.split(F.btrim("text", F.lit(_BLANKS)), BLANK + "+"), _bare)
    words = texts.select(words.alias("words")).select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.size("words")).alias("next"))).alias("z"))
    near = F.explode(F.array(F.col("z.w"), F.concat(F.col("z.w"), F.lit(" "), F.col("z.next")))).alias("near")
    names = wanted.select("near").distinct()
    counts = words.select(near).where("near IS NOT NULL").join(checked_broadcast(names), "near").groupBy("near").agg(F.count("*").alias("total"))
    return wanted.join(counts, "near")


def bootstrap(scratch: Scratch, found: DataFrame, texts: DataFrame) -> DataFrame:
    """word and kind of the identifiers that confident patterns discover.

    found: word, left, left2, right, kind (null if not a seed), a row per occurrence. texts: text, all documents.
    """
    edges = _patterns(found, "word", "kind").groupBy("side", "near", "word").agg(F.count("*").alias("n"), F.max("kind").alias("seed"))
    edges = scratch.save(edges, "edges")
    wanted = edges.groupBy("side", "near").agg(F.count("*").alias("words"), F.count("seed").alias("seeds")).where(F.col("words") >= SEEDS)
    wanted = scratch.save(wanted, "wanted")
    seeds = edges.where("seed IS NOT NULL").groupBy("word").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    nothing = seeds.select("word", "kind").limit(0)
    if wanted.where(F.col("seeds") >= SEEDS).isEmpty():
        return nothing
    totals = scratch.save(pattern_totals(texts, wanted.select("side", "near")), "totals")
    graph = scratch.save(edges.join(checked_broadcast(totals), ["side", "near"]), "graph")
    score = scratch.save(seeds, "score")
    for _ in range(ROUNDS):
        held = graph.join(checked_broadcast(score), "word")
        sure = F.col("score") >= CONFIDENCE
        pattern = held.groupBy("side", "near").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.max("total") + 1)).alias("confidence"), F.count(F.when(sure, 1)).alias("support"), F.mode(F.when(sure, F.col("kind")), True).alias("of")
        )
        pattern = scratch.save(pattern.where(F.col("support") >= SEEDS), "patterns")
        reached = graph.join(checked_broadcast(pattern), ["side", "near"])
        best = reached.groupBy("word").agg(F.max("confidence").alias("score"), F.max_by("of", F.struct("confidence", "of")).alias("kind"))
        after = best.join(seeds.select("word", F.lit(True).alias("seeded")), "word", "left_anti").select("word", "kind", "score")
        score = scratch.save(seeds.select("word", "kind", "score").unionByName(after), "score")
    found = score.where(F.col("score") >= CONFIDENCE).join(seeds.select("word"), "word", "left_anti")
    return found.select("word", "kind")


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_context of every row of docs.

    A null or empty text has no spans: counts 0, the hash of the empty string, spans ''. Rows with equal doc_id and text get equal results,
    those without doc_id too; a null doc_id stays null. Empty input: no rows. Spans are in code points, end exclusive. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    base = base_spans(F.col("text"))
    marked = rows.select("doc_id", "key", *(c.alias(k) for k, c in base), _shaped(F.col("text")).alias("shaped"))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    marked = scratch.save(marked.select("doc_id", "key", *(slim(k).alias(k) for k in KINDS), "shaped"), "marked")
    once = marked.where(F.size("shaped") > 0).dropDuplicates(["doc_id", "key"])
    tagged = once.select("doc_id", "key", _seeded(F.col("shaped"), {k: F.col(k) for k in KINDS}).alias("shaped"))
    found = tagged.select("doc_id", "key", F.explode("shaped").alias("i")).select("doc_id", "key", "i.*").where("start < stop")
    found = scratch.save(found, "found")
    unseen = scratch.save(bootstrap(scratch, found, rows), "unseen")
    new = found.where("kind IS NULL").drop("kind").join(checked_broadcast(unseen), "word").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.concat(F.lit("ctx_"), "kind").alias("kind"), "stop")).alias("more"))
    first = spans.in_order([(k, F.col(k)) for k in KINDS])
    out = marked.select("doc_id", "key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), first.alias("base")).alias("m")
    out = out.join(new.alias("x"), F.col("m.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("m.key") == F.col("x.key")), "left").select("m.*", "more")
    every = F.sort_array(F.concat("base", F.coalesce("more", F.slice("base", F.lit(1), F.lit(0)))))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(every).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_context"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))
