"""The filter audit against a plain evaluation of every order, and its duplicates against equality of texts."""

import glob
import itertools
import os
import re
from collections import Counter

import duckdb
import pytest

from tabulon.llm import filter_audit

WIDE = "doc_id long, text string, source string, part string, mask string, key string, least string, class string, n int, blocks string"


def brute(docs, labels):
    docs = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and i > least[t]}
        rows.append((s, fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = rows
        for step, f in enumerate(order, 1):
            for part in {r[0] for r in rows}:
                own, here = [r for r in rows if r[0] == part], [r for r in left if r[0] == part]
                lost = [r for r in here if r[1][f]]
                fail = sum(r[1][f] for r in own)
                out[part, order, step] = [len(here) - len(lost), len(lost), fail - len(lost), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[part, f] += len(lost)
            left = [r for r in left if not r[1][f]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(got) == len(rows)
    return got


def texts():
    many, few = " ".join(f"w{i}" for i in range(60)), "one two"
    long = " ".join(f"x{i % 50_000}" for i in range(300_000))
    found = [many, many, few, "", None, many.upper(), many + " #", "a a a " * 40, "a a a " * 40, many[:-1] + "é", many[:-1] + "\U0001f600", many[:-1] + "z", " ".join("pq" * 30), "A B\x1cC", long, long, long + "y", long + "z"]
    # equal length and first blocks, different ends
    return found + [many * 20 + c for c in "abca"]


DOCS = [(i, t, ["x", None, "", "y"][i % 4]) for i, t in enumerate(texts())] + [(None, "one two", "x"), (None, texts()[0], "x"), (3, "one two", "x"), (3, "one two", "x"), (2, "one two", "x"), (-5, "", "y")]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, 1, 1), (2, 1, 1), (5, None, None), (99, 1, 1), (None, 1, 1), (8, 1, 0), (15, 1, 1)]


def frames(spark):
    docs = spark.createDataFrame([(*d, "p", "m", "k", "l", "c", 1, "b") for d in DOCS], WIDE).repartition(3)
    return docs, spark.createDataFrame([(*x, "e") for x in LABELS], "doc_id long, quality int, toxic int, text string")


def test_all_orders(spark):
    assert result(filter_audit.audit(*frames(spark))) == brute(DOCS, LABELS)


def test_texts_that_share_a_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "text_key", lambda t: filter_audit.F.length(t).cast("long") % 7)
    assert result(filter_audit.audit(*frames(spark))) == brute(DOCS, LABELS)


def test_refinement_keeps_only_classes_of_two(spark):
    scratch = filter_audit.Scratch(spark)
    rows = [(1, 10, [1]), (2, 10, [1]), (3, 10, [2]), (4, 700, [1, 2, 3]), (4, 700, [1, 2, 3]), (5, 700, [1, 2, 4]), (6, 700, [1, 3, 3]), (7, 11, [1]), (8, 0, []), (8, 0, []), (9, 5000, [1, 2, 3, 4]), (10, 5000, [1, 2, 3, 5])]
    got = filter_audit.refine(scratch, spark.createDataFrame(rows, "key long, length long, blocks array<long>"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 4, 8]


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert result(filter_audit.audit(docs, labels.limit(0))) == brute(DOCS, [])


def test_registered_query_equals_sql(spark, small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({filter_audit.ORACLE_SQL}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r) for r in filter_audit.query(spark, small).select(*names).collect()) == want


@pytest.mark.parametrize(("text", "mask"), [("", 1), ("# " * 60, 2 + 8), ("A" * 10, 1 + 4)])
def test_masks(text, mask):
    assert filter_audit.failed(text.encode(), len(text)) == mask
