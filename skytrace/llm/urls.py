"""URL filter: rules by host and path, and where none fits, the ratio of two character language models.

The models are variable-order Markov models of accepted and of rejected URLs, learned from the URLs that rules decide: the chance
of a character after its last ORDER characters is its count there, smoothed by the chance after one character less. A URL's score
is the mean over its characters of log P(accepted model) - log P(rejected model), each at the longest context that the models have
seen with it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import partitions, written

ORDER = 4
#: Weight of the shorter context; chance of a character never seen; one URL in so many calibrates the threshold.
SMOOTH, UNSEEN, HOLD_OUT = 4.0, 1 / 256, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host(url: str | Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null or a text without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None)
    for own, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character of each URL: gram is the character with the ORDER before it, padded at the start. The URL is cut into
    characters once, so a row costs the same whatever its length."""
    padded = F.concat(F.array_repeat(F.lit("\0"), ORDER), F.split("url", ""))
    grams = F.transform(F.sequence(F.lit(0), F.size("chars") - ORDER - 1), lambda i: F.concat(*[F.get("chars", i + k) for k in range(ORDER + 1)]))
    return urls.where("length(url) > 0").select(*keep, padded.alias("chars")).select(*keep, F.explode(grams).alias("gram"))


def _tail(gram: str, order: int) -> Column:
    return F.substring(gram, ORDER + 1 - order, order + 1)


def fit(ruled: DataFrame) -> list[DataFrame]:
    """For each order, (gram, ratio): the log ratio of every gram that the URLs have. ruled: (url, good)."""
    counts = _grams(ruled.repartition(partitions(ruled.sparkSession)), ["good"]).groupBy("gram").agg(F.count_if("good").cast("double").alias("a"), F.count_if(~F.col("good")).cast("double").alias("b"))
    counts = written(counts, "grams")
    below, tables = None, []
    for order in range(ORDER + 1):
        own = counts.groupBy(_tail("gram", order).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = own.groupBy(F.substring("gram", 1, order).alias("context")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        own = own.withColumn("context", F.substring("gram", 1, order)).join(context, "context")
        if below is None:
            own = own.withColumn("pa", F.lit(UNSEEN)).withColumn("pb", F.lit(UNSEEN))
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, order)).join(below.select(F.col("gram").alias("shorter"), "pa", "pb"), "shorter")
        smooth = lambda n, total, shorter: (F.col(n) + SMOOTH * F.col(shorter)) / (F.col(total) + SMOOTH)
        below = written(own.select("gram", "a", "b", smooth("a", "ca", "pa").alias("pa"), smooth("b", "cb", "pb").alias("pb")), "chances")
        tables.append(below.select("gram", (F.log("pa") - F.log("pb")).alias("ratio")))
    return tables


def score(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(url, score) of distinct URLs; empty ones are left out."""
    numbered = written(urls.where("length(url) > 0").repartition(partitions(urls.sparkSession)).select(F.monotonically_increasing_id().alias("n"), "url"), "asked")
    grams = _grams(numbered, ["n"]).groupBy("n", "gram").agg(F.count("*").alias("times"))
    # Each distinct gram gets its ratio once, from order to order, so that no join has a hot key: a gram goes on in as many as there
    # are characters. Rows of a gram that many URLs have are dealt by AQE.
    asked, known = written(grams.select("gram").distinct(), "asked_grams"), None
    for order, ratios in enumerate(tables):
        own = asked.select(_tail("gram", order).alias("gram")).distinct().join(ratios.hint("shuffle_merge"), "gram", "left")
        if known is None:
            known = own.select("gram", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
        else:
            shorter = known.select(F.col("gram").alias("shorter"), F.col("ratio").alias("less"))
            known = own.withColumn("shorter", F.substring("gram", 2, order)).join(shorter, "shorter").select("gram", F.coalesce("ratio", "less").alias("ratio"))
        known = written(known, "known")
    score = F.sum(F.col("times") * F.col("ratio")) / F.sum("times")
    return grams.join(known.hint("shuffle_merge"), "gram").groupBy("n").agg(score.alias("score")).join(numbered, "n").select("url", "score")


def threshold(scored: DataFrame) -> float:
    """The score that tells accepted from rejected URLs with the least sum of both error rates. scored: (score, good). From counts in
    steps of 0.01 between -20 and 20, halfway between neighbouring ones; 0 where one side is missing."""
    step = F.round(F.greatest(F.least("score", F.lit(20)), F.lit(-20)) * 100).cast("int")
    bins = sorted(scored.groupBy(step.alias("bin")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("b")).collect())
    good, bad = sum(r.a for r in bins), sum(r.b for r in bins)
    if not good or not bad:
        return 0.0
    lost, kept, best, last = 0, bad, (1.0, bins[0].bin - 1), bins[0].bin - 1
    for r in bins:
        best = min(best, (lost / good + kept / bad, (r.bin + last) / 2))
        lost, kept, last = lost + r.a, kept - r.b, r.bin
    return best[1] / 100


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages: the longest fitting rule's verdict, else allow where the score
    reaches the threshold.

    Models are learned from the distinct URLs that rules decide, but for one in HOLD_OUT by hash, which calibrates the threshold.
    A URL without characters, null ones too, has score 0. Without rules' URLs every score is 0 and the verdict allow. Repeated rows
    stay, also those that share an id; a URL of any length costs in proportion to it; other columns are left out, and an empty table
    gives no rows.
    """
    split = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"))
    split = split.withColumn("chosen", rule_of(F.col("host"), F.col("path"), rules)) if rules else split.withColumn("chosen", F.lit(None).cast("struct<rule:string,verdict:string>"))
    good = F.col("chosen.verdict") == "allow"
    urls = split.where("length(url) > 0").groupBy("url").agg(F.first(good).alias("good"))
    urls = written(urls.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0), "urls")
    tables = fit(urls.where("good is not null and not held").select("url", "good"))
    scored = written(score(urls.where("good is null or held").select("url"), tables), "scores")
    level = threshold(scored.join(urls.where("good is not null and held"), "url").select("score", "good"))
    open_ = split.where("chosen is null").join(scored, "url", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.coalesce("score", F.lit(0.0)) >= level, "allow").otherwise("block").alias("verdict"))
    ruled = split.where("chosen is not null").select("page_id", "host", "path", F.col("chosen.rule").alias("rule"), F.col("chosen.verdict").alias("verdict"))
    return ruled.unionByName(open_)
