"""URL filters: allow and block rules by host and path, and a logistic regression on hashed character n-grams for the URLs that no rule decides.

The classifier is trained on a small labelled URL table. Its features are all runs of 3 to 5 characters of the host and of the path, kept apart, hashed into
FEATURES columns; a URL has a feature or hasn't. Rules and scores are column expressions over the pages: no shuffle, and of the pages only the URL is read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS, FEATURES = (3, 4, 5), 1 << 16
#: Regularization, steps, and the most labelled rows that the model is fitted on (those of least hash, if the table has more).
PENALTY, STEPS, LABELLED = 0.002, 60, 50_000
#: A URL is blocked from this probability on.
THRESHOLD = 0.5
#: Rules are part of the plan; so many of them at most.
MOST_RULES = 10_000
FITTING = "array<struct<length:int,host_length:int,rule:string,verdict:string,path:string>>"
#: (verdict, host in lower case, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Words of hosts and paths that a training corpus does without, and of ordinary ones. The labelled table is put together from them.
UNWANTED = (
    "casino", "poker", "pills", "pharmacy", "payday", "loans", "lottery", "jackpot", "betting", "bets", "replica", "cheap", "spam", "farm", "links", "porn", "escort", "torrent", "warez", "crack", "keygen",
    "malware", "phish", "clickbait", "popup", "adserver", "tracker", "freebies", "giveaway", "prize", "diploma", "weightloss", "miracle", "adult",
)
ORDINARY = (
    "library", "university", "news", "recipes", "garden", "museum", "weather", "travel", "science", "history", "music", "school", "hospital", "council", "railway", "kitchen", "books", "journal", "research", "sports",
    "village", "river", "mountain", "photo", "forum", "docs", "wiki", "health", "design", "theatre", "bridge", "castle", "there", "other", "mention", "station", "thing", "mother", "nation", "winter",
)
UNWANTED_PATHS, ORDINARY_PATHS = ("buy-now", "free-bonus", "win-prize", "order-cheap-pills", "download-crack", "hot-deals"), ("about", "articles", "history", "index.html", "archive", "notes")
NEUTRAL_PATHS, ZONES, FRONTS = ("en/{}", "de/{}.html", "fr/{}/", "es/{}", "{}"), ("com", "org", "net"), ("www.", "", "blog.", "m.")


def labelled_table() -> list[tuple[str, str]]:
    """(url, verdict) of the small labelled table: each word in four hosts, once in three with a path of its kind; zones, fronts and languages are shared alike."""
    rows = []
    for verdict, words, own in (("block", UNWANTED, UNWANTED_PATHS), ("allow", ORDINARY, ORDINARY_PATHS)):
        for i, word in enumerate(words):
            for k in range(4):
                n = 4 * i + k
                host = (word, f"{word}-{words[(i + 7) % len(words)]}", f"{words[(i + 11) % len(words)]}{word}", f"{word}{n % 10}")[k]
                path = f"{own[n % len(own)]}/{n}" if n % 3 == 0 else NEUTRAL_PATHS[n % len(NEUTRAL_PATHS)].format(n * 37 % 1000)
                rows.append((f"https://{FRONTS[n % 5 % 4]}{host}.{ZONES[n % 3]}/{path}", verdict))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lowered) and the path of a URL; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of rules of one length that with the longer host, then the last by name.

    A rule fits its host and all subdomains of it, if the path starts with the rule's. Of a rule that is given twice block counts.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[Column]] = {}
    for verdict, host_of, start in rules:
        cell = {"length": len(host_of) + len(start), "host_length": len(host_of), "rule": host_of + start, "verdict": verdict, "path": start}
        by_host.setdefault(host_of, []).append(F.struct(*(F.lit(v).alias(k) for k, v in cell.items())))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table, none = F.create_map(*(c for h, own in by_host.items() for c in (F.lit(h), F.array(*own)))), F.array().cast(FITTING)
    # the last k labels of the host (all, if it has no more), for each number of labels that rules have
    ends = [F.substring_index(host, ".", -k) for k in sorted({h.count(".") + 1 for h in by_host})]
    found = F.flatten(F.array(*(F.coalesce(F.try_element_at(table, e), none) for e in ends)))
    best = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def grams(host: Column, path: Column) -> Column:
    """The n-grams of host and path as strings, `h` or `p` before each; begin and end of both count as characters."""
    def of(text: Column, mark: str) -> Column:
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        run = lambda c, n: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda x, i: F.concat(F.lit(mark), x, *(F.get(c, i + j) for j in range(1, n))))
        return F.flatten(F.transform(F.array(letters), lambda c: F.concat(*(run(c, n) for n in GRAMS))))

    return F.concat(of(host, "h"), of(path, "p"))


def _featured(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(rows)


def fit(labelled: DataFrame, most: int = LABELLED) -> LogisticRegressionModel:
    """The classifier of a labelled table (url, verdict: allow or block; other rows don't count), fitted on `most` rows at most, those of least hash."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("verdict").isin("allow", "block")).select("url", (F.col("verdict") == "block").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most).select("label", grams(host, path).alias("_grams")).coalesce(1)  # one task: sums in one order
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=PENALTY, maxIter=STEPS, standardization=False, threshold=THRESHOLD, rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction").fit(_featured(rows))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row of pages (page_id, url); further columns are not read.

    The verdict is the rule's, else the classifier's. A url without host and path has the marks of two empty texts as its only features.
    Equal urls get equal verdicts. Empty table: no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", ruling(F.col("host"), F.col("path"), rules)).withColumn("_grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(_featured(rows))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("_prediction") == 1, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, fit(spark.createDataFrame(labelled_table(), "url string, verdict string")))
