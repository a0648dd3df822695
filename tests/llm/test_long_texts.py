"""Personal data and secrets in texts of a hundred thousand labels or matches, and cue words of any length."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tabulon.llm import pii, secret_scan, spans


def scanned(spark, scan, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    return {r["doc_id"]: r for r in scan(docs).collect()}


def digest(places):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in places).encode()).hexdigest()


def test_hosts_of_many_labels(spark):
    many = "x@" + "a." * 100_000 + "com"
    got = scanned(spark, pii.find_personal, [many, many + ". end", "x@" + "a-" * 100_000, "a." * 100_000 + "@b.c"])
    assert [got[i]["n_email"] for i in range(4)] == [1, 1, 0, 1]
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == digest([("email", 0, len(many))])


@pytest.mark.parametrize(("scan", "piece", "kind", "length"), [(pii.find_personal, "1.2.3.4 ", "ip", 7), (pii.find_personal, "a@b.cd ", "email", 6), (pii.find_personal, "+123456789; ", "phone", 10), (pii.find_personal, "4111111111111111; ", "card", 16), (secret_scan.scan_secrets, "token=abcdefgh1 ", "assign", 15)])
def test_many_matches_in_one_text(spark, scan, piece, kind, length):
    n = 100_000
    began = time.time()
    got = scanned(spark, scan, [piece * n])[0]
    assert time.time() - began < 120
    assert got[f"n_{kind}"] == n and got["base_sha256"] == digest([(kind, k * len(piece), k * len(piece) + length) for k in range(n)])


def test_context_words_of_any_length(spark):
    def corpus(cue):
        return [f"{cue} {4000000000 + 7919 * i} now" for i in range(8)] + [f"{cue} +49 30 {1000000 + 31 * i} now" for i in range(8)]

    for cue in ("hotline", "h" * 1000, "hotline:" + " " * 400):
        got = scanned(spark, pii.find_personal, corpus(cue))
        assert all("ctx_phone" in got[i]["spans"] for i in range(8)), cue[:20]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_places_across_runs(spark, n):
    text = "".join(f"x{i} " for i in range(n))
    row = spark.createDataFrame([(text,)], "t string").select(spans.matches(F.col("t"), "x[0-9]+", lambda hit, part: F.length(hit) > 0).alias("m")).first()
    at, want = 0, []
    for i in range(n):
        want.append((at, at + len(f"x{i}")))
        at = want[-1][1] + 1
    assert [(m["start"], m["stop"]) for m in row["m"]] == want


def test_formats_of_any_length(spark):
    long = "ghp_" + "aB3" * 5000
    token = f"eyJ{'a1' * 3000}.eyJ{'b2' * 5000}.{'c3' * 2000}"
    got = scanned(spark, secret_scan.scan_secrets, [f"x {long} y", f"x {token} y", "eyJ" + "a" * 200_000, "eyJ" * 60_000])
    assert f"format:2:{2 + len(long)}" in got[0]["spans"] and f"format:2:{2 + len(token)}" in got[1]["spans"]
    assert "format" not in got[2]["spans"] and "format" not in got[3]["spans"]
