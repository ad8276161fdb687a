"""One query per operator: each applies it to its whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.llm import bpe, chunks, identifiers, mixing, periods, quality, shards, toxicity, turns, urls, vectors
from skytrace.llm.common import WORD, crc32_of_id, new_folder, table, written
from skytrace.llm.simhash import fingerprint_text, near_duplicate_groups


def _held_out(mod: int, is_: int) -> F.Column:
    return F.coalesce(crc32_of_id("doc_id") % mod == is_, F.lit(False))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its size, its source's size and target, and the words the mix takes of it. A null or empty text has size 0, a
    null source is a source, and null ids come first among documents of one size; equal rows share what they are taken by. Ties of size
    go by id, then by a digest of the whole row. Texts may be of any length; other columns only tell rows apart; an empty table gives no rows."""
    drawn = mixing.copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: whether its labels were held out, its score and what it comes to. A null or empty text has the score of no sign;
    rows that share an id are scored each by its own text, repeated ones alike; a null id is never held out and never labelled. Of
    repeated labels one that says toxic tells. Without toxic labels all score 0. Texts are read whole, whatever their length; other
    columns, also one called toxic_score, are not read; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    predicted = (F.col("toxic_score") >= toxicity.REJECT_FROM).cast("int")
    return rated.select("doc_id", _held_out(3, 1).alias("held_out"), F.col("toxic_score").alias("score"), predicted.alias("predicted"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth id. Null ids ask and answer nothing; vectors that are null, zero or hold null or non-finite
    components take no part, those of another length are no neighbours. Equal distances go by the smaller id; of repeated rows with an
    id one asks, each answers. Other columns are not read; an empty table gives no rows."""
    return vectors.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its fingerprint and the least id that links reach. Null, empty and blank texts have fingerprint zero and link
    like any other; repeated rows stay; a null id names no group unless all its members are null. Texts may be of any length; other
    columns are not read; an empty table gives no rows."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("fingerprint", fingerprint_text(groups["fp"])).select("doc_id", "fingerprint", "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: how many ids its text has, and digests of the ids and of what they decode to. A null text counts as empty;
    repeated rows and ids stay. Texts may be of any length, runs of white space too; other columns are not read; an empty table gives no rows."""
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document of which passages go, with the byte ranges and the documents that keep them."""
    spans = chunks.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "starts", "ends", "cut_bytes", "first_ids")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: whether its labels were held out, its score and what it comes to. Null and empty texts are scored by what little
    they show; rows that share an id are scored each by its own text, repeated ones alike. Without labels all score alike. Texts are
    read whole; other columns, also one called quality_score, are not read; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = quality.score(docs, quality.fit(docs, labels))
    predicted = (F.col("quality_score") >= quality.KEEP_FROM).cast("int")
    return rated.select("doc_id", _held_out(5, 0).alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page: host, path, the rule that fits and the verdict. A null URL or one without :// has neither host nor path and no rule;
    repeated rows and ids stay; of rules that fit, the longest wins. A URL may be of any length; other columns are not read; an empty
    table gives no rows."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document as its shard's index has it: where its ids begin, how many they are, and their crc32. A null text counts as
    empty; repeated rows have entries of their own, a null id too; ties of ids go by a digest of the text. Texts may be of any length;
    other columns are not read; an empty table gives no rows. An id that is no whole number comes back as its type casts it."""
    docs, path = table(spark, sf_dir, "documents"), new_folder(spark, "ids")
    shards.write_shards(docs, path)
    doc_id = F.col("key").cast(docs.schema["doc_id"].dataType)
    return shards.read_index(spark, path).select(doc_id.alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector: how many others it links to, the least id that links reach, and whether it is that one. Vectors that are null, zero
    or hold null or non-finite components, and those of another length, link with nothing. Repeated rows count as vectors; a null id
    names no group unless all its members are null, and is kept only then. Other columns are not read; an empty table gives no rows."""
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: how many of each kind the fixed patterns find, their digest, and all spans, the added ones too. Null and
    empty texts have none; repeated rows and ids, null ones too, are rows of their own."""
    found = identifiers.personal_data(table(spark, sf_dir, "documents"))
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, identifiers.KINDS)), s["kind"] + 1), s["start"], s["end"])
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(identifiers.KINDS)]
    listed = lambda spans: F.array_join(F.transform(spans, named), ",")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The contract's damage: in a tenth of the texts, told by their ids, the words from some place on repeat the first of them."""
    words, n, a, p = F.regexp_extract_all("text", F.lit(WORD), 0), F.col("_n"), F.col("_a"), F.col("_p")
    code = crc32_of_id("doc_id")
    split = docs.select("doc_id", "text", F.when((code % 10 == 0) & F.col("text").isNotNull(), words).alias("_words"), F.floor(code / 10).alias("_g"))
    placed = split.withColumn("_n", F.size("_words").cast("long")).withColumn("_a", F.when(n > 0, F.col("_g") % n))
    placed = placed.withColumn("_p", 1 + F.floor((n - a) / (3 + F.col("_g") % 8)))
    head, unit = F.slice("_words", F.lit(1), a.cast("int")), F.slice("_words", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return placed.select("doc_id", F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document of the periodic runs of its words after the contract's damage: their number, the longest one (nulls without
    any), and digests of all runs and of the text without what they repeat. A null doc_id is not damaged; rows stay as they are,
    repeated ones too."""
    found = periods.with_runs(_made_periodic(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_best"), F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation of its faults after the contract's damage and of the cheapest repair. Null ids are one conversation;
    turns without a number come first; one whose turns are all dropped has zeros, no edits and the digest of an empty text."""
    conversations = table(spark, sf_dir, "conversations")
    known, edited = turns.repair(turns.damaged(conversations))
    told, whole = written(known, "summary"), turns.as_documents(edited).withColumnRenamed("conv_id", "_conv")
    both = told.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(both, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = lambda c: F.coalesce(c, F.lit(""))
    return every.select("conv_id", *counts, none("audit").alias("audit"), F.sha2(none("repaired"), 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_toxicity, op3_neighbours, op4_simhash, op5_bpe, op6_substrings, op7_quality, op8_urls, op9_shards, op10_embeddings, op11_personal_data, op12_periods, op13_turns)}

_SOURCES = """
sized AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows,
  (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source),
capped AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level,
  2.0::DOUBLE * source_size / weight AS stop FROM per
  WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, stop) FILTER (WHERE level < stop) AS level FROM capped),
targets AS (SELECT source, source_size, n_rows, least(source_size::DOUBLE * 2, coalesce(level, 0) * weight) AS target FROM per, water)"""

ORACLE_SQL: dict[str, str] = {
    "op1_mix": f"""WITH {_SOURCES},
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
  ('0x' || substr(md5('mix' || coalesce('1' || s.source, '0')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(place * each + u) - floor((place - 1) * each + u)) * size)::BIGINT AS taken FROM placed"""
}
