"""Queries over gliders, users, jobs and codes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions import gliders, text
from skytrace.operators import accounts, listing, resolve, snapshots
from skytrace.plans.tables import table
from skytrace.sources import catalog, stored
from skytrace.storage import drained, place, replayed
from skytrace.streaming import queue

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


BRAND_NAMES = [(1, "Brand#11"), (2, "Brand#12"), (3, "Brand#13"), (4, "Brand#21"), (5, "No Brand")]
RULES = [(1, "pg", "brand-11", "(?i)^s", "essential"), (2, "pg", "brand-11", "(?i)e", "eagle"), (3, "hg", "brand-12", "[aeiou]{2}", "combat"), (4, "pg", "brand-12", "x", "xray"), (5, "pg", "brand-12", "a", "alpha")]
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_KIND = "CASE WHEN {b} & 1 <> 0 THEN 'pg' WHEN {b} & 6 <> 0 THEN 'hg' WHEN {b} & 8 <> 0 THEN 'sp' WHEN {b} & 16 <> 0 THEN 'pg' ELSE 'other' END"


@query(f"""WITH names AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{b}')" for n, b in BRAND_NAMES)}) v(brand_no, brand)),
rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) v(n, kind, brand_id, pattern, model_id)),
g AS (SELECT p_partkey AS id, p_size AS user_id, {_KIND.format(b="CAST(p_partkey % 32 AS INT)")} AS kind, CAST(p_partkey % 7 AS INT) AS brand_no, trim(p_name) AS text, {_SLUG.format("p_name")} AS slug FROM part),
brands AS (SELECT DISTINCT {_SLUG.format("p_brand")} AS brand_id FROM part), models AS (SELECT DISTINCT {_SLUG.format("p_brand")} AS brand_id, 'pg' AS kind, {_SLUG.format("p_name")} AS model_id FROM part WHERE p_size > 30),
n AS (SELECT g.*, {_SLUG.format("names.brand")} AS brand_id, CASE WHEN kind = 'other' THEN 'no airframe' WHEN g.brand_no = 0 THEN 'no brand picked' WHEN names.brand IS NULL THEN 'unknown brand'
  WHEN {_SLUG.format("names.brand")} NOT IN (SELECT brand_id FROM brands) THEN 'brand not in the catalogue' END AS skipped FROM g LEFT JOIN names USING (brand_no)),
r AS (SELECT n.*, m.model_id IS NOT NULL AS direct, (SELECT arg_min(rules.model_id, rules.n) FROM rules WHERE rules.kind = n.kind AND rules.brand_id = n.brand_id AND regexp_matches(n.text, rules.pattern)) AS alias
  FROM n LEFT JOIN models m ON m.brand_id = n.brand_id AND m.kind = n.kind AND m.model_id = n.slug)
SELECT id, CASE WHEN skipped IS NULL THEN brand_id END AS brand_id, kind, CASE WHEN skipped IS NULL THEN CASE WHEN direct THEN slug ELSE coalesce(alias, user_id || ':' || slug) END END AS model_id,
coalesce(skipped, CASE WHEN direct THEN 'model' WHEN alias IS NOT NULL THEN 'alias' ELSE 'custom' END) AS outcome FROM r""")
def gliders_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and model of the gliders of a legacy log."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("user_id"), F.expr("int(p_partkey % 32)").alias("category"), F.expr("int(p_partkey % 7)").alias("brand_no"), F.col("p_name").alias("text"))
    brands = part.select(text.slug(F.col("p_brand")).alias("brand_id")).distinct()
    models = part.where("p_size > 30").select(text.slug(F.col("p_brand")).alias("brand_id"), F.lit("pg").alias("kind"), text.slug(F.col("p_name")).alias("model_id")).distinct()
    names = spark.createDataFrame(BRAND_NAMES, "brand_no int, brand string")
    rules = spark.createDataFrame(RULES, "n int, kind string, brand_id string, pattern string, model_id string")
    return resolve.resolved(asked, names, brands, models, rules)


_OWNED = """f AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'b1' WHEN o_orderkey % 2 = 0 THEN o_custkey || ':b' ELSE 'b2' END AS brand_id, o_orderstatus AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_orderkey % 5 ELSE o_custkey || ':m' || o_orderkey % 4 END AS model_id FROM orders),
m AS (SELECT DISTINCT brand_id, kind, model_id, 'name ' || model_id AS name, CASE WHEN contains(model_id, ':') THEN user_id END AS user_id FROM f),
b AS (SELECT DISTINCT brand_id, 'name ' || brand_id AS name, CASE WHEN contains(brand_id, ':') THEN user_id END AS user_id FROM f),
j AS (SELECT f.*, CASE WHEN f.id % 5 = 1 THEN f.user_id + 1 END AS new_user, m.user_id AS mu, b.user_id AS bu, m.name AS mn, b.name AS bn FROM f JOIN m USING (brand_id, kind, model_id) JOIN b USING (brand_id)),
g AS (SELECT *, coalesce(new_user IS NOT NULL AND mu = user_id, false) AS goes, coalesce(new_user IS NOT NULL AND mu = user_id AND bu = user_id, false) AS brand_goes FROM j),
after AS (SELECT id, coalesce(new_user, user_id) AS user_id, CASE WHEN brand_goes THEN new_user || ':' || split_part(brand_id, ':', 2) ELSE brand_id END AS brand_id, kind, CASE WHEN goes THEN new_user || ':' || split_part(model_id, ':', 2) ELSE model_id END AS model_id,
  goes, brand_goes, brand_id AS old_brand, model_id AS old_model, mn, bn FROM g),
m2 AS (SELECT brand_id, kind, model_id, user_id FROM m UNION SELECT brand_id, kind, model_id, user_id FROM after WHERE goes),
m3 AS (SELECT * FROM m2 WHERE (brand_id, kind, model_id) NOT IN (SELECT (old_brand, kind, old_model) FROM after WHERE goes) OR (brand_id, kind, model_id) IN (SELECT (brand_id, kind, model_id) FROM after)),
b2 AS (SELECT brand_id, user_id FROM b UNION SELECT brand_id, user_id FROM after WHERE brand_goes),
b3 AS (SELECT * FROM b2 WHERE brand_id NOT IN (SELECT old_brand FROM after WHERE brand_goes) OR brand_id IN (SELECT brand_id FROM m3))"""


@query(f"""WITH {_OWNED} SELECT 'flight' AS what, id::VARCHAR AS id, user_id, brand_id, model_id FROM after UNION ALL SELECT 'model', kind, user_id, brand_id, model_id FROM m3 UNION ALL SELECT 'brand', NULL, user_id, brand_id, NULL FROM b3""")
def flights_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of all flights change their owner: flights, models and brands after it."""
    key, user, text_ = F.col("o_orderkey"), F.col("o_custkey"), lambda *c: F.concat(*c)
    own = lambda rest: text_(user.cast("string"), F.lit(":"), *rest)
    brand = F.when(key % 3 == 0, "b1").when(key % 2 == 0, own([F.lit("b")])).otherwise("b2")
    model = F.when(key % 3 == 0, text_(F.lit("m"), (key % 5).cast("string"))).otherwise(own([F.lit("m"), (key % 4).cast("string")]))
    flights = table(spark, sf_dir, "orders").select(key.alias("id"), user.alias("user_id"), brand.alias("brand_id"), F.col("o_orderstatus").alias("kind"), model.alias("model_id"))
    private = lambda c: F.when(F.contains(F.col(c), F.lit(":")), F.col("user_id")).alias("user_id")
    models = flights.select("brand_id", "kind", "model_id", F.concat(F.lit("name "), "model_id").alias("name"), private("model_id")).distinct()
    brands = flights.select("brand_id", F.concat(F.lit("name "), "brand_id").alias("name"), private("brand_id")).distinct()
    moves = flights.where("id % 5 = 1").select("id", (F.col("user_id") + 1).alias("new_user"))
    after, kept_models, kept_brands = snapshots.flights_transferred(flights, models, brands, moves)
    none = F.lit(None).cast("string")
    out = after.select(F.lit("flight").alias("what"), F.col("id").cast("string").alias("id"), "user_id", "brand_id", "model_id")
    out = out.unionByName(kept_models.select(F.lit("model").alias("what"), F.col("kind").alias("id"), "user_id", "brand_id", "model_id"))
    return out.unionByName(kept_brands.select(F.lit("brand").alias("what"), none.alias("id"), "user_id", "brand_id", none.alias("model_id")))


_LOG = "log AS (SELECT user_id AS flight_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_t, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS event, props AS error FROM events)"


@query(f"""WITH {_LOG}, booted AS (SELECT max(at_t) - 86400 AS b FROM log), j AS (SELECT flight_id, min(at_t) FILTER (WHERE event = 'queued') AS created_at, count(*) FILTER (WHERE event = 'running') AS attempts,
  arg_max(event, at_t) FILTER (WHERE event <> 'queued') AS last, max(at_t) FILTER (WHERE event = 'running') AS started_at, max(at_t) FILTER (WHERE event IN ('done', 'failed')) AS finished_at,
  arg_max(event, at_t) FILTER (WHERE event IN ('done', 'failed')) AS ended, arg_max(error, at_t) FILTER (WHERE event IN ('done', 'failed')) AS error FROM log GROUP BY 1),
s AS (SELECT flight_id, coalesce(last, 'queued') AS state, attempts, created_at, started_at, finished_at, CASE WHEN ended = 'failed' THEN error END AS error FROM j WHERE created_at IS NOT NULL)
SELECT flight_id, CASE WHEN state = 'running' AND started_at < b THEN 'queued' ELSE state END AS state, attempts, created_at, CASE WHEN state = 'running' AND started_at < b THEN NULL ELSE started_at END AS started_at, finished_at, error FROM s, booted""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scoring job after a start: those that ran before it are queued again."""
    event = F.col("event_type")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(event == "click", "running").when(event == "purchase", "done").when(event == "error", "failed").otherwise("queued").alias("event"), F.col("props").alias("error"))
    booted = log.agg((F.max("at") - 86_400).alias("_booted"))
    return queue.recovered(queue.states(log).join(F.broadcast(booted)), F.col("_booted")).drop("_booted")  # one row


# Seconds until a failed job is tried again, and until one that runs is given up; what may be told late.
RETRY_S, STALL_S, LATE_S = 40_000, 200_000, 100_000


@query(f"""WITH told AS (SELECT user_id AS flight_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS at_ms, event_id AS n, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS event, 'event ' || event_id AS error FROM events),
since AS (SELECT *, bool_or(event = 'queued') OVER up AS known, count(*) FILTER (WHERE event = 'queued') OVER up AS q, max(at_ms) OVER (PARTITION BY flight_id) AS last FROM told WINDOW up AS (PARTITION BY flight_id ORDER BY at_ms, n ROWS UNBOUNDED PRECEDING)),
taken AS (SELECT * FROM since WHERE known AND (event <> 'queued' OR q = 1)),
states AS (SELECT *, count(*) FILTER (WHERE event = 'running') OVER up AS attempts, last_value(CASE event WHEN 'failed' THEN error WHEN 'done' THEN '' END IGNORE NULLS) OVER up AS err, lead(at_ms) OVER (PARTITION BY flight_id ORDER BY at_ms, n) AS next FROM taken WINDOW up AS (PARTITION BY flight_id ORDER BY at_ms, n ROWS UNBOUNDED PRECEDING)),
timers AS (SELECT *, CASE event WHEN 'running' THEN at_ms + {STALL_S * 1000} WHEN 'failed' THEN CASE WHEN attempts < 3 THEN at_ms + {RETRY_S * 1000} END END AS due FROM states),
told_all AS (SELECT flight_id, at_ms, event AS state, attempts, err FROM timers UNION ALL SELECT flight_id, due, 'queued', attempts, err FROM timers WHERE due IS NOT NULL AND CASE WHEN next IS NOT NULL THEN due <= next ELSE due <= last OR due < (SELECT max(at_ms) FROM told) - {LATE_S * 1000} END)
SELECT flight_id, at_ms, state, attempts, nullif(err, '') AS error FROM told_all""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state that scoring jobs come to, retries and runs that were given up among them, as a stream tells it."""
    event = F.col("event_type")
    told = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight_id"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"), F.col("event_id").alias("n"), F.when(event == "click", "running").when(event == "purchase", "done").when(event == "error", "failed").otherwise("queued").alias("event"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"))
    stream = queue.lifecycle(replayed(told, 1_000_000), 3, RETRY_S, STALL_S, f"{LATE_S} seconds")
    return drained(stream).select("flight_id", F.unix_millis("at").alias("at_ms"), "state", "attempts", "error")


@query("""SELECT c_custkey AS user_id, c_name AS model FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey = 7""")
def visible_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that belong to all, and those of one user."""
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("model"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("owner"))
    return listing.visible_to(models, 7, "owner").select("user_id", "model")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS found UNION ALL SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def flights_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether flights of a kind exist."""
    orders = table(spark, sf_dir, "orders")
    return listing.any_row(orders.where("o_totalprice > 1000")).unionByName(listing.any_row(orders.where("o_totalprice < 0")))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS id, user_id AS flight_id FROM events WHERE event_type = 'purchase'")
def jobs_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of jobs that was emptied, and then had others put in: their identities start again at 1."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("flight_id"))
    path = place(spark, "jobs")
    jobs.write.parquet(path)
    stored.truncate(spark, path)
    start = snapshots.next_id(spark.read.parquet(path), "id").first()[0]
    queued = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("long").alias("flight_id"), "ts", "event_id")
    listing.earlier_count(queued, ["ts", "event_id"]).select((F.col("ahead") + start).cast("long").alias("id"), "flight_id").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT c_custkey AS user_id, c_name AS name, n_name AS country, CASE WHEN c_custkey % 4 = 0 THEN 'imperial' WHEN c_custkey % 4 = 1 THEN CASE WHEN n_regionkey = 1 THEN 'imperial' ELSE 'metric' END ELSE 'metric' END AS units
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 WHERE c_custkey IN (1, 2, 3, 4, 5, 8, 9, 13, 21, 34, 55, 89)""")
def user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users by key, with profile and resolved preferences."""
    users = table(spark, sf_dir, "customer").where(F.col("c_custkey").isin(1, 2, 3, 4, 5, 8, 9, 13, 21, 34, 55, 89))
    profiles = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    own = F.when(F.col("c_custkey") % 4 == 0, "imperial").when(F.col("c_custkey") % 4 == 1, "system").when(F.col("c_custkey") % 4 == 2, "metric")
    system = F.when((F.col("n_regionkey") == 1) & (F.col("c_custkey") % 4 == 1), "imperial")
    return users.join(profiles, "c_nationkey", "left").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), text.preference(own, system, "metric").alias("units"))


@query("""WITH s AS (SELECT *, upper(substr(c_mktsegment, 1, 2)) AS code, CASE c_custkey % 7 WHEN 0 THEN ' Male ' WHEN 1 THEN 'f' WHEN 2 THEN 'X' WHEN 3 THEN 'diverse' WHEN 4 THEN 'FEMALE' WHEN 5 THEN 'other' END AS sx FROM customer)
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 > 0 THEN code END AS country, CASE WHEN c_custkey % 5 > 0 THEN chr(127397 + ascii(code)) || chr(127397 + ascii(substr(code, 2))) END AS flag,
CASE lower(trim(sx)) WHEN 'male' THEN 'm' WHEN 'f' THEN 'f' WHEN 'female' THEN 'f' WHEN 'x' THEN 'd' WHEN 'diverse' THEN 'd' END AS sex,
translate(substr(to_base64(unhex(sha256(c_name || '/' || c_custkey))), 1, 8), '+/', '-_') AS short_id, contains(lower(c_name), '00a') OR contains(lower(c_name), '7') AS found,
CASE WHEN c_acctbal < 0 THEN '−' ELSE '+' END || printf('%.1f', abs(c_acctbal) % 1000) AS balance, trim(replace(c_name, '#', ' ')) AS model, c_custkey % 3 = 0 AS is_tandem FROM s""")
def codes_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries, flags, sexes, short ids, signed numbers and model names of users as texts."""
    key, name = F.col("c_custkey"), F.col("c_name")
    raw = F.when(key % 5 > 0, F.concat(F.lit(" "), F.substring("c_mktsegment", 1, 2), F.lit(" "))).otherwise("1?")
    spelled = F.element_at(F.array(*[F.lit(x) for x in (" Male ", "f", "X", "diverse", "FEMALE", "other", None)]), (key % 7 + 1).cast("int"))
    code = text.country(raw)
    model = text.model_name(F.concat(F.lit(" "), F.translate(name, "#", " "), F.when(key % 3 == 0, text.TANDEM_SUFFIX).otherwise("")))
    found = text.contains_ignoring_case(name, "00A") | text.contains_ignoring_case(name, "7")
    balance = text.signed(F.abs("c_acctbal") % 1000, 1, F.when(F.col("c_acctbal") < 0, -1).otherwise(1))
    out = table(spark, sf_dir, "customer").select(key.alias("user_id"), code.alias("country"), text.flag(code).alias("flag"), text.sex(spelled).alias("sex"), text.short_id(F.concat(name, F.lit("/"), key.cast("string"))).alias("short_id"), found.alias("found"), balance.alias("balance"), model.alias("m"))
    return out.select("user_id", "country", "flag", "sex", "short_id", "found", "balance", F.col("m.name").alias("model"), F.col("m.is_tandem").alias("is_tandem"))


@query("""WITH m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'pg' ELSE 'hg' END AS kind, 'b' || p_size % 3 AS brand_slug, 's' || p_partkey % 40 AS slug, p_name AS name, CASE WHEN p_partkey % 40 <> 7 THEN 'en_a' END AS class FROM part),
k AS (SELECT kind, brand_slug, slug, count(*) AS n, count(DISTINCT name) AS names, bool_or(class IS NULL) AS u FROM m GROUP BY ALL)
SELECT kind, brand_slug, slug, 'class' AS error FROM k WHERE u UNION ALL SELECT kind, brand_slug, slug, 'listed twice' FROM k WHERE n > names UNION ALL SELECT kind, brand_slug, slug, 'slugs collide' FROM k WHERE names > 1""")
def catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a catalogue's models."""
    key = F.col("p_partkey") % 40
    m = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "pg").otherwise("hg").alias("kind"), F.concat(F.lit("b"), (F.col("p_size") % 3).cast("string")).alias("brand_slug"), F.concat(F.lit("s"), key.cast("string")).alias("slug"), F.col("p_name").alias("name"), F.when(key != 7, "en_a").alias("class"))
    return catalog.errors(m)


@query(f"""SELECT p_partkey AS id, k.kind, k.key, CASE WHEN list_contains({list(gliders.CLASSES["pg"])}, k.key) AND k.kind = 'pg' OR list_contains({list(gliders.CLASSES["hg"])}, k.key) AND k.kind = 'hg' OR list_contains({list(gliders.CLASSES["sp"])}, k.key) AND k.kind = 'sp' THEN replace(k.key, '-', '_') END AS class
FROM part, (VALUES {", ".join(f"('{k}', '{c}')" for k in ("pg", "hg", "sp") for c in ("en-a", "ccc", "kingpost", "rigid", "open", "club", "none"))}) k(kind, key)""")
def glider_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in a catalogue's spelling, for the kinds that have them and for others."""
    asked = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("key")) for k in ("pg", "hg", "sp") for c in ("en-a", "ccc", "kingpost", "rigid", "open", "club", "none")])
    both = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(asked).alias("_asked")).select("id", "_asked.*")
    return both.select("id", "kind", "key", gliders.glider_class(F.col("kind"), F.col("key")).alias("class"))


_SOURCES = "sources AS (SELECT o_orderkey AS flight_id, 'b' || o_custkey % 5 AS brand, CASE WHEN o_orderkey % 3 = 0 THEN 'hg' ELSE 'pg' END AS kind, 'm' || o_custkey % 17 AS model, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
_RESCORED = "news AS (SELECT l_orderkey AS flight_id, CAST(count(*) AS BIGINT) AS cents FROM lineitem WHERE l_partkey % 40 = 3 GROUP BY 1 UNION ALL SELECT -flight_id, cents FROM sources WHERE cents % 500 = 1)"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Where sources are stored by bucket, after an upsert, and what became of each of its rows."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda letter, n: F.concat(F.lit(letter), (owner % n).cast("string")).alias({"b": "brand", "m": "model"}[letter])
    rows = table(spark, sf_dir, "orders").select(key.alias("flight_id"), name("b", 5), F.when(key % 3 == 0, "hg").otherwise("pg").alias("kind"), name("m", 17), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    path = place(spark, "sources")
    stored.write(rows, path, ["flight_id"], 32)
    again = table(spark, sf_dir, "lineitem").where("l_partkey % 40 = 3").groupBy(F.col("l_orderkey").alias("flight_id")).agg(F.count("*").alias("cents"))
    fresh = rows.where("cents % 500 = 1").select((-F.col("flight_id")).alias("flight_id"), "cents")
    new = again.unionByName(fresh).select("flight_id", F.lit("none").alias("brand"), F.lit("pg").alias("kind"), F.lit("none").alias("model"), "cents")
    return path, stored.upsert_into(spark, path, new, ["flight_id"], ["cents"], 32)


@query(f"""WITH {_SOURCES}, {_RESCORED} SELECT flight_id, coalesce(brand, 'none') AS brand, coalesce(kind, 'pg') AS kind, coalesce(model, 'none') AS model, coalesce(n.cents, s.cents) AS cents,
CASE WHEN s.flight_id IS NULL THEN 'inserted' WHEN n.flight_id IS NOT NULL THEN 'updated' END AS outcome FROM sources s FULL JOIN news n USING (flight_id)""")
def buckets_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by bucket after an upsert that sets one column, with what the upsert did to each row."""
    path, done = _stored(spark, sf_dir)
    return stored.read(spark, path, ["flight_id"]).join(done, "flight_id", "left")


@query(f"""WITH {_SOURCES}, {_RESCORED}, after AS (SELECT flight_id, coalesce(brand, 'none') AS brand, coalesce(kind, 'pg') AS kind, coalesce(model, 'none') AS model, coalesce(n.cents, s.cents) AS cents FROM sources s FULL JOIN news n USING (flight_id)),
wanted AS (SELECT DISTINCT l_orderkey AS flight_id FROM lineitem WHERE l_quantity > 45), models AS (SELECT DISTINCT brand, kind, model, brand || ' ' || model || ' ' || kind AS name FROM sources WHERE model <> 'm3')
SELECT flight_id, cents, name FROM after JOIN wanted USING (flight_id) JOIN models USING (brand, kind, model)""")
def sources_by_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sources of a table of wanted flights, with the glider's name by brand, kind and model; others' buckets aren't read."""
    path, _ = _stored(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("flight_id"))
    models = table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("brand"), F.when(F.col("o_orderkey") % 3 == 0, "hg").otherwise("pg").alias("kind"), F.concat(F.lit("m"), (F.col("o_custkey") % 17).cast("string")).alias("model"))
    named = models.where("model <> 'm3'").distinct().withColumn("name", F.concat_ws(" ", "brand", "model", "kind"))
    return stored.read(spark, path, ["flight_id"], wanted, 32).join(named, ["brand", "kind", "model"]).select("flight_id", "cents", "name")


@query("""WITH users AS (SELECT c_custkey AS user_id, c_mktsegment || c_custkey % 400 AS name FROM customer), asked AS (SELECT CASE WHEN c_custkey % 9 > 0 THEN c_custkey END AS user_id, c_custkey AS n, lower(c_mktsegment) || c_custkey * (1 + c_custkey % 2) % 400 AS name FROM customer)
SELECT n, user_id, name, EXISTS (SELECT 1 FROM users u WHERE lower(u.name) = lower(a.name) AND u.user_id IS DISTINCT FROM a.user_id) AS taken FROM asked a""")
def names_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that users ask for, and whether another user has them."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    users = c.select(key.alias("user_id"), F.concat("c_mktsegment", (key % 400).cast("string")).alias("name"))
    asked = c.select(key.alias("n"), F.when(key % 9 > 0, key).alias("user_id"), F.concat(F.lower("c_mktsegment"), (key * (1 + key % 2) % 400).cast("string")).alias("name"))
    return accounts.name_taken(asked, users)


_NEW_USERS = "SELECT o_orderkey AS n, CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE trim('User ' || o_custkey) END AS name, CASE WHEN o_orderkey % 17 > 0 THEN 'c' || o_custkey || '@x.org' END AS email FROM orders"


@query(f"""WITH new AS ({_NEW_USERS}), v AS (SELECT *, trim(name) <> '' AS valid FROM new), r AS (SELECT *, row_number() OVER (PARTITION BY email, valid ORDER BY n) AS k FROM v)
SELECT n, trim(name) AS name, email, CASE WHEN NOT valid THEN 'invalid' WHEN email IS NOT NULL AND (k > 1 OR email IN (SELECT 'c' || c_custkey || '@x.org' FROM customer WHERE c_custkey % 3 = 0)) THEN 'conflict' ELSE 'inserted' END AS outcome FROM r""")
def users_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who sign up, as they are stored, and what becomes of each."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    there = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"))
    new = table(spark, sf_dir, "orders").select(key.alias("n"), F.when(key % 13 == 0, "  ").otherwise(F.concat(F.lit(" User "), owner)).alias("name"), F.when(key % 17 > 0, F.concat(F.lit("C"), owner, F.lit("@X.org "))).alias("email"))
    return accounts.users_added(there, new)


@query("""WITH p AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'imperial' WHEN 1 THEN 'system' WHEN 2 THEN 'metric' END AS u, CASE c_custkey % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'fpm' END AS v, CASE c_custkey % 5 WHEN 0 THEN 'mph' WHEN 1 THEN 'kmh' WHEN 2 THEN 'system' END AS s,
CASE c_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'AT' WHEN 3 THEN 'LR' WHEN 4 THEN 'MM' END AS region FROM customer), r AS (SELECT *, CASE WHEN u IN ('imperial', 'metric') THEN u WHEN region IN ('US', 'GB', 'LR', 'MM') THEN 'imperial' ELSE 'metric' END AS units FROM p)
SELECT user_id, units, CASE WHEN v = 'fpm' OR units = 'imperial' THEN 'fpm' ELSE 'mps' END AS vario_unit, CASE WHEN s IN ('mph', 'kmh') THEN s WHEN units = 'imperial' THEN 'mph' ELSE 'kmh' END AS speed_unit FROM r""")
def preferences_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all users; climb and speed follow the units where nothing else is chosen."""
    key, pick = F.col("c_custkey"), lambda by, n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (by % n + 1).cast("int"))
    p = text.preferences(pick(key, 4, "imperial", "system", "metric", None), pick(key, 3, "system", "fpm", None), pick(key, 5, "mph", "kmh", "system", None, None), pick(F.col("c_nationkey"), 6, "US", "GB", "AT", "LR", "MM", None))
    return table(spark, sf_dir, "customer").select(key.alias("user_id"), p.alias("p")).select("user_id", "p.*")


@query("""WITH a AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 140 - 10 END AS asked, o_custkey % 2 = 0 AS sites FROM orders)
SELECT request_id, CASE WHEN asked IS NULL THEN CASE WHEN sites THEN 50 ELSE 25 END WHEN asked BETWEEN 1 AND 100 THEN CAST(asked AS INT) END AS "limit", CASE WHEN asked NOT BETWEEN 1 AND 100 THEN 'limit must be from 1 to 100' END AS error FROM a""")
def limits_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes that requests ask for: 25 flights or 50 sites where none is, and an error beyond 100."""
    key = F.col("o_orderkey")
    asked = F.when(key % 7 > 0, key % 140 - 10)
    p = F.when(F.col("o_custkey") % 2 == 0, listing.page_limit(asked, 50)).otherwise(listing.page_limit(asked, 25))
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), p.alias("p")).select("request_id", "p.*")
