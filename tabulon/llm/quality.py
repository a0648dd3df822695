"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much rejected. DataFrame functions only."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import BLANK, documents

#: Base limits: fewest words; most words in repeated windows, in percent; words of a window.
FEWEST, REPEATED, WINDOW = 20, 30, 8
#: A document may lose so much of its non-blank text, in percent.
LOSS = 50
# Blanks; marks that end a sentence; what may stand behind them; marks between the entries of a menu; marks that running text has few of;
# and phrases of page furniture in English, German, French and Spanish, in lower case.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?:;…。！？؟।"
CLOSERS = "\"'”’»)]" + BLANKS
SEPARATORS = "|>»·•›"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!?=~_^+@/\\{}"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "click here", "sign up", "log in", "subscribe", "javascript", "lorem ipsum", "share this", "read more",
    "back to top", "powered by", "skip to content", "newsletter",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "hier klicken", "anmelden", "weiterlesen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "s'inscrire", "lire la suite", "haut de page",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic", "regístrate", "leer más", "volver arriba",
)
#: A boilerplate phrase condemns a line of at most so many characters; a longer one may well quote it.
SHORT_LINE = 120


def _count(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, marked: Column) -> Column:
    """True if a line with a word breaks a rule: no sentence end, navigation separators, boilerplate, or marks in most words.

    `marked` tells whether its text has any of MARKS or SEPARATORS: other texts need no counts. Words are taken as the pieces between single
    spaces here; no rule needs them exactly.
    """
    ended = lambda x: F.substring(x, -1, 1).isin(*ENDS)
    unfinished = ~(ended(line) | ended(F.rtrim(line, F.lit(CLOSERS))))
    pieces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    crowded = F.exists(F.array(pieces), lambda n: (_count(line, SEPARATORS) * 3 >= n + 3) | (_count(line, MARKS) >= n + 2))
    low = lambda x: functools.reduce(lambda a, p: a | x.contains(p), BOILERPLATE, F.lit(False))
    return unfinished | (marked & crowded) | ((F.length(line) <= SHORT_LINE) & F.exists(F.array(F.lower(line)), low))


def _marked(text: Column) -> Column:
    return text.rlike(f"[{re.escape(MARKS + SEPARATORS)}]")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _with_next(hashes: Column, step: int) -> Column:
    """The hash of each element and the one `step` behind it; the last `step` stand alone."""
    behind = F.slice(hashes, F.lit(step + 1), F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.zip_with(hashes, behind, lambda a, b: F.xxhash64(a, b))


def repeated_words(ordered: Column) -> Column:
    """Words in windows that occur twice; `ordered` has (hash, place) of all windows, sorted, or null if all hashes differ."""
    nothing = F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("i"))
    behind = F.concat(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.array(nothing))
    twins = F.zip_with(ordered, behind, lambda x, y: F.when((x["h"] == y["h"]) & (y["i"] >= 0), F.array(x["i"], y["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.coalesce(covered, F.lit(0))


def assess(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost (non-blank characters on failing lines), kept.

    A null text has no words and fails. Equal rows get equal verdicts. Rules run on whole texts of any length. Columns of docs with
    these names are replaced.
    """
    return _assessed(docs).drop("_marked")


def _assessed(docs: DataFrame) -> DataFrame:
    """assess() with _marked, which line_fails() asks for."""
    text = F.coalesce("text", F.lit(""))
    solid = lambda c: F.length(F.translate(c, BLANKS, ""))
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.when(inner != "", F.split(inner, BLANK + "+", -1)).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_words").cast("long"))
    # a window's hash is put together from halves: pairs, fours, eights
    for step in (1, 2, 4):
        rows = rows.withColumn("_words", _with_next(F.col("_words"), step))
    rows = rows.withColumn("_windows", F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))).drop("_words")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_ordered", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    rows = rows.withColumn("n_repeat_words", repeated_words(F.col("_ordered")).cast("long")).drop("_ordered")
    rows = rows.withColumn("word_chars", solid(text).cast("long")).withColumn("n_symbols", _count(text, SYMBOLS).cast("long"))
    rows = rows.withColumn("_marked", _marked(text)).withColumn("_lines", F.filter(F.split(text, "\n", -1), _has_word))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    lost = F.aggregate(F.filter("_lines", lambda x: line_fails(x, F.col("_marked"))), F.lit(0).cast("long"), lambda a, x: a + solid(x))
    rows = rows.withColumn("base_failed", failed).withColumn("lost", F.when(F.col("base_failed"), F.col("word_chars")).otherwise(lost)).drop("_lines")
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost") <= LOSS * F.col("word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that assess() keeps, without their failing lines; the columns of docs, n_chars renewed if docs has it.

    Null, empty and blank texts go, as they have too few words. Equal rows are treated alike. Empty input: no rows. Columns with any names pass through.
    """
    names = docs.columns
    judged = _assessed(docs.select(F.struct("*").alias("_row"), "text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~(_has_word(x) & line_fails(x, F.col("_marked"))))
    # a filter moved below the steps of assess() would compute each of them anew wherever the next one reads it; it does not pass a generator
    verdict = F.explode(F.array(F.struct("kept", F.when(F.col("kept"), F.array_join(lines, "\n")).alias("text")))).alias("v")
    out = judged.select("_row", verdict).where("v.kept")
    made = {"text": F.col("v.text"), "n_chars": F.length("v.text").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assess(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")
