"""Queries over flights, users, gliders, routes and sites, with their SQL. Flights are orders, users customers, routes lines, gliders parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions import geo, text
from skytrace.operators import listing, sites, snapshots
from skytrace.plans.tables import FIXES, SITES, fixes, haversine_sql, table
from skytrace.plans.tables import sites as site_table
from skytrace.sources import catalog
from skytrace.streaming import queue

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


PAGE_KEYS = [("takeoff_at", True), ("flight_id", True)]


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flight_id"), F.col("o_custkey").alias("user_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("takeoff_at"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("kind"))


_FLIGHTS = "flights AS (SELECT o_orderkey AS flight_id, o_custkey AS user_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS takeoff_at, o_totalprice AS score, o_orderstatus AS kind FROM orders)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey")
    countries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return flights(spark, sf_dir).join(users, "user_id").join(countries, "c_nationkey", "left").select("flight_id", "takeoff_at", "score", F.col("c_name").alias("pilot"), F.col("n_name").alias("country"))


_FEED = f"""{_FLIGHTS}, feed AS (SELECT f.flight_id, f.takeoff_at, f.score, c.c_name AS pilot, n.n_name AS country FROM flights f
  JOIN customer c ON c.c_custkey = f.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""


@query(f"WITH {_FEED} SELECT * FROM feed ORDER BY takeoff_at DESC, flight_id DESC LIMIT 26")
def tracks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest flights with pilot and country, and one more."""
    return listing.page(_feed(spark, sf_dir), PAGE_KEYS, 25)


@query(f"""WITH {_FEED}, cur AS (SELECT takeoff_at AS t0, flight_id AS f0 FROM feed ORDER BY takeoff_at DESC, flight_id DESC LIMIT 1 OFFSET 24),
page AS (SELECT feed.* FROM feed, cur WHERE takeoff_at < t0 OR (takeoff_at = t0 AND flight_id < f0) ORDER BY takeoff_at DESC, flight_id DESC LIMIT 26)
SELECT *, (SELECT count(*) > 25 FROM page) AS has_more FROM page ORDER BY takeoff_at DESC, flight_id DESC LIMIT 25""")
def tracks_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first, by keyset; the cursor goes through its text form."""
    feed = _feed(spark, sf_dir)
    last = listing.page(feed, PAGE_KEYS, 25).select("takeoff_at", "flight_id").collect()[24]
    at, key = listing.decode_cursor(listing.encode_cursor(last.takeoff_at, str(last.flight_id)))
    return listing.with_more(listing.page(feed, PAGE_KEYS, 25, [at, int(key)]), PAGE_KEYS, 25)


@query(f"""WITH {_FLIGHTS} SELECT f.flight_id, f.takeoff_at, c.c_name AS pilot, n.n_name AS country, r.r_name AS region, l.l_partkey AS model_id, p.p_brand AS brand, p.p_name AS model
FROM flights f JOIN customer c ON c.c_custkey = f.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN lineitem l ON l.l_orderkey = f.flight_id AND l.l_linenumber = 1 LEFT JOIN part p ON p.p_partkey = l.l_partkey WHERE f.kind = 'F'""")
def flight_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights of a kind with everything that describes them: a star join with a constant predicate on one branch."""
    read = lambda name: table(spark, sf_dir, name)
    first = read("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("flight_id"), F.col("l_partkey").alias("model_id"))
    out = flights(spark, sf_dir).where("kind = 'F'").join(read("customer"), F.col("user_id") == F.col("c_custkey"))
    out = out.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = out.join(first, "flight_id", "left").join(read("part"), F.col("model_id") == F.col("p_partkey"), "left")
    return out.select("flight_id", "takeoff_at", F.col("c_name").alias("pilot"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), "model_id", F.col("p_brand").alias("brand"), F.col("p_name").alias("model"))


@query("SELECT DISTINCT p_brand AS brand FROM part p WHERE p_size > 10 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')")
def brands_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that have a model of a class that some flight used: a semi join."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 10").join(used, "p_partkey", "left_semi").select(F.col("p_brand").alias("brand")).distinct()


@query("SELECT p_partkey AS model_id, p_brand AS brand, p_name AS model FROM part p WHERE p_size <= 25 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49) OR p_size > 25")
def orphan_models_reaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after models of users that no flight refers to are gone."""
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), "p_size")
    busy = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("model_id"))
    return snapshots.reap_orphans(models, busy, ["model_id"], F.col("p_size") <= 25).select("model_id", "brand", "model")


@query(f"""WITH {FIXES}, {SITES}, starts AS (SELECT * FROM fixes WHERE idx = 0),
near AS (SELECT p.flight_id, s.site_id, {haversine_sql("p.lat_e5", "p.lon_e5", "s.lat_e5", "s.lon_e5")} AS d FROM starts p, sites s),
best AS (SELECT flight_id, arg_min(site_id, (d, site_id)) AS site_id, min(d) AS d FROM near WHERE d <= 2500 GROUP BY flight_id)
SELECT p.flight_id, b.site_id, round(b.d, 3) AS distance_m FROM starts p LEFT JOIN best b USING (flight_id)""")
def nearest_takeoff_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight's nearest site within 2.5 km of its first fix, null without one."""
    starts = fixes(spark, sf_dir).where("idx = 0").select("flight_id", "lat_e5", "lon_e5")
    return sites.nearest_site(starts, site_table(spark, sf_dir), "flight_id", 2500).select("flight_id", "site_id", F.round("distance_m", 3).alias("distance_m"))


@query("SELECT l_orderkey AS flight_id, arg_max(l_returnflag || l_linestatus, (l_extendedprice, -l_linenumber)) AS main_type, max(l_extendedprice) AS main_score FROM lineitem GROUP BY 1")
def main_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight's best route; ties go to the first line."""
    best = F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("n"), F.concat("l_returnflag", "l_linestatus").alias("type")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("flight_id")).agg(best.alias("b")).select("flight_id", F.col("b.type").alias("main_type"), F.col("b.l_extendedprice").alias("main_score"))


@query("""WITH best AS (SELECT l_orderkey, max(l_extendedprice) AS s FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
SELECT o_orderkey AS flight_id, coalesce(b.s, o_totalprice) AS main_score FROM orders LEFT JOIN best b ON b.l_orderkey = o_orderkey""")
def main_score_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update from a subquery: flights with a new best score take it, others keep theirs."""
    best = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("s"))
    return table(spark, sf_dir, "orders").join(best, "o_orderkey", "left").select(F.col("o_orderkey").alias("flight_id"), F.coalesce("s", "o_totalprice").alias("main_score"))


@query("SELECT o_orderkey AS flight_id, l_linenumber AS version FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linenumber < 3")
def pending_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tracks of an older version than the current one."""
    tracks = queue.behind(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("version")), 3)
    return flights(spark, sf_dir).where("kind = 'O'").join(tracks, "flight_id").select("flight_id", "version")


KINDS = ["P", "O", "F"]


@query("""SELECT o_custkey AS user_id, o_orderstatus AS kind, o_orderpriority AS class, count(*) AS n, list_position(['P', 'O', 'F'], o_orderstatus) AS kind_rank
FROM orders GROUP BY ALL""")
def my_gliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights by user and glider, with the kind's place in its enum."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("n"))
    return counted.withColumn("kind_rank", listing.ranked_enum(F.col("kind"), KINDS).cast("int"))


@query("""SELECT c_custkey AS user_id, (c_nationkey & ~1) <> 0 AS is_staff, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_flights
FROM customer ORDER BY is_staff DESC, c_acctbal DESC, c_custkey DESC LIMIT 26""")
def users_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by a derived flag, with a correlated count."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    users = table(spark, sf_dir, "customer").withColumn("is_staff", F.col("c_nationkey").bitwiseAND(~1) != 0)
    # The page is cut first, so only its rows are joined with the counts.
    top = listing.page(users, [("is_staff", True), ("c_acctbal", True), ("c_custkey", True)], 25)
    return top.join(n, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), "is_staff", F.coalesce("n", F.lit(0)).alias("n_flights"))


@query("SELECT event_id, rank() OVER (ORDER BY ts, event_id) - 1 AS ahead FROM events WHERE event_type = 'signup'")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queued jobs are ahead of each."""
    queued = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", "ts")
    return listing.earlier_count(queued, ["ts", "event_id"]).select("event_id", "ahead")


@query("""WITH used AS (SELECT o_custkey AS user_id, o_orderstatus AS kind, o_orderpriority AS class, o_orderdate AS flown, o_orderkey AS id FROM orders),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, class ORDER BY flown DESC, id DESC) AS n FROM used),
four AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY flown DESC, id DESC) AS place FROM one WHERE n = 1) SELECT user_id, kind, class, id, place::INT AS place FROM four WHERE place <= 4""")
def recent_gliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four gliders of every user: the newest flight per glider, on the map side first, and of those the four newest."""
    newest = F.max(F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))).alias("n")
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("class")).agg(newest)
    one = one.select("user_id", "kind", "class", "n.at", "n.id")
    return one.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("id").desc()))).where("place <= 4").select("user_id", "kind", "class", "id", "place")


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_name ILIKE '%r#00000001%' ESCAPE '!'")
def users_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose name holds a text, whatever its case; signs of the pattern language count as they are."""
    pattern = "%" + text.like_escaped("R#00000001") + "%"
    return table(spark, sf_dir, "customer").where(F.col("c_name").ilike(pattern)).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("SELECT min(c_custkey) AS user_id, lower(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 1")
def names_taken_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one user has, whatever their case."""
    return table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("user_id"), F.count("*").alias("n")).where("n > 1")


@query("""WITH rules AS (SELECT * FROM (VALUES (1, 'Brand#1.', 'one'), (2, 'Brand#.[3-5]', 'upper'), (3, 'Brand#2', 'two')) r(n, pattern, alias)),
hit AS (SELECT p_partkey, min(n) AS n FROM part, rules WHERE regexp_matches(p_brand, pattern) GROUP BY 1)
SELECT p.p_partkey AS model_id, coalesce(r.alias, 'custom') AS alias FROM part p LEFT JOIN hit USING (p_partkey) LEFT JOIN rules r ON r.n = hit.n""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose pattern a model matches, else 'custom'. Rules are matched once per distinct brand."""
    rules = spark.createDataFrame([(1, "Brand#1.", "one"), (2, "Brand#.[3-5]", "upper"), (3, "Brand#2", "two")], "n int, pattern string, alias string")
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), "p_brand")
    hits = models.select("p_brand").distinct().join(F.broadcast(rules), F.expr("p_brand rlike pattern")).groupBy("p_brand").agg(F.min(F.struct("n", "alias")).alias("hit"))
    return models.join(hits, "p_brand", "left").select("model_id", F.coalesce("hit.alias", F.lit("custom")).alias("alias"))


@query("""WITH old AS (SELECT l_orderkey AS flight_id, l_linenumber AS type, l_extendedprice AS score, l_returnflag AS note FROM lineitem WHERE l_linenumber <= 2),
new AS (SELECT l_orderkey AS flight_id, l_linenumber AS type, l_extendedprice * 2 AS score, 'new' AS note FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3)
SELECT coalesce(o.flight_id, n.flight_id) AS flight_id, coalesce(o.type, n.type) AS type, coalesce(n.score, o.score) AS score, coalesce(o.note, n.note) AS note,
CASE WHEN o.flight_id IS NULL THEN 'inserted' WHEN n.flight_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM old o FULL JOIN new n ON o.flight_id = n.flight_id AND o.type = n.type""")
def routes_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes after an upsert that sets the score only."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("type"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("note"))
    new = lines.where("type between 2 and 3").withColumn("score", F.col("score") * 2).withColumn("note", F.lit("new"))
    return snapshots.upsert(lines.where("type <= 2"), new, ["flight_id", "type"], ["score"])


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 3 = 0")
def flights_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert that skips flights which are there already."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return snapshots.insert_missing(rows.where("id % 3 <> 0"), rows.withColumn("user_id", F.lit(-1).cast("long")), ["id"])


@query("SELECT 'flight' AS kind, o_orderkey AS id, 0 AS line FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'track', l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 <> 0")
def flights_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after flights and what refers to them are deleted."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = snapshots.delete_with_children(orders.where("o_custkey % 5 = 0"), "o_orderkey", (orders, "o_orderkey"), (lines, "l_orderkey"))
    return left[0].select(F.lit("flight").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("line")).unionByName(left[1].select(F.lit("track").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'set' END ELSE c_mktsegment END AS segment,
CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS balance FROM customer""")
def profiles_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates: absent fields stay, given ones are set, a given null overwrites."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    given = lambda g, v: F.struct(F.expr(g).alias("given"), F.expr(v).alias("value"))
    changes = users.where("user_id % 4 = 0").select("user_id", given("true", "if(user_id % 8 = 0, null, 'set')").alias("segment"), given("user_id % 3 = 0", "0.0D").alias("balance"))
    return snapshots.update_given(users, changes, ["user_id"])


@query("SELECT p_partkey AS model_id, CASE WHEN p_size % 7 = 3 THEN p_size + 1000 ELSE p_size END AS user_id, CASE WHEN p_size % 7 = 3 THEN (p_size + 1000) || ':' || p_name ELSE p_size || ':' || p_name END AS slug FROM part")
def models_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private models that go with their owner's flights to another user."""
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_size").alias("user_id"), F.concat(F.col("p_size").cast("string"), F.lit(":"), "p_name").alias("slug"))
    moves = models.where("user_id % 7 = 3").select(F.col("user_id").alias("old")).distinct().withColumn("new", F.col("old") + 1000)
    return snapshots.transferred(models, moves, "user_id", "slug")


@query("SELECT greatest(coalesce(max(o_orderkey), 0), 1) AS next_id FROM orders")
def next_flight_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.next_id(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("customer", "orders", "lineitem")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_MODELS = """m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'pg' ELSE 'hg' END AS kind, lower(replace(p_brand, '#', '-')) AS brand_slug, p_partkey::VARCHAR AS slug, p_name AS name, p_type AS class, p_size > 25 AS is_tandem, p_size FROM part),
old AS (SELECT * FROM m WHERE p_size < 30), new AS (SELECT *  REPLACE (name || ' II' AS name) FROM m WHERE p_size > 15)"""


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of models imported over a table that has some of them."""
    kind = F.when(F.col("p_size") % 2 == 0, "pg").otherwise("hg")
    m = table(spark, sf_dir, "part").select(kind.alias("kind"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"), F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("name"), F.col("p_type").alias("class"), (F.col("p_size") > 25).alias("is_tandem"), "p_size")
    return catalog.imported(m.where("p_size < 30").drop("p_size"), m.where("p_size > 15").withColumn("name", F.concat("name", F.lit(" II"))))


@query(f"""WITH {_MODELS} SELECT coalesce(n.kind, o.kind) AS kind, coalesce(n.brand_slug, o.brand_slug) AS brand_slug, coalesce(n.slug, o.slug) AS slug, coalesce(n.name, o.name) AS name, coalesce(n.class, o.class) AS class,
coalesce(n.is_tandem, o.is_tandem) AS is_tandem, CASE WHEN o.slug IS NULL THEN 'inserted' WHEN n.slug IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM old o FULL JOIN new n ON o.kind = n.kind AND o.brand_slug = n.brand_slug AND o.slug = n.slug""")
def catalog_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's table after an import, with what became of each model."""
    return _imported(spark, sf_dir)


@query(f"""WITH {_MODELS} SELECT coalesce(n.kind, o.kind) AS kind, count(*) FILTER (WHERE o.slug IS NULL) AS added, count(*) FILTER (WHERE o.slug IS NOT NULL AND n.slug IS NOT NULL) AS updated,
count(*) FILTER (WHERE n.slug IS NOT NULL AND n.is_tandem) AS tandems FROM old o FULL JOIN new n ON o.kind = n.kind AND o.brand_slug = n.brand_slug AND o.slug = n.slug GROUP BY 1""")
def catalog_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many models an import adds and updates, by kind."""
    return catalog.import_summary(_imported(spark, sf_dir))


@query("SELECT p_name AS name, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM part GROUP BY 1")
def model_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of model names and how many models share them."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).withColumn("slug", text.slug(F.col("name")))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(source || ' é ' || lang || chr(192 + (doc_id % 6)::INT))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def source_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of names with marked letters."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("source"), F.lit(" é "), F.col("lang"), F.char(192 + F.col("doc_id") % 6))
    return docs.select("doc_id", text.slug(name).alias("slug"))


@query("SELECT s_suppkey AS site_id, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN length(s_name) < 3 THEN 'name' END, CASE WHEN s_nationkey > 20 THEN 'country' END) AS errors FROM supplier")
def site_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each site."""
    check = lambda bad, name: F.when(F.expr(bad), name)
    found = F.array_compact(F.array(check("s_acctbal < 0", "balance"), check("length(s_name) < 3", "name"), check("s_nationkey > 20", "country")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.array_join(found, ",").alias("errors"))


@query(f"""WITH {FIXES} SELECT flight_id, event_id, floor((lon_e5 / 1e5 + 180) / 360 * 4096)::INT AS x,
floor((0.5 - asinh(tan(radians(lat_e5 / 1e5))) / (2 * pi())) * 4096)::INT AS y, round(lat_e5 / 1e5, 5) AS lat FROM fixes""")
def fix_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile at zoom 12 that each fix lies in."""
    zoom = F.lit(12)
    x, y = geo.mercator_x(geo.degrees("lon_e5")), geo.mercator_y(geo.degrees("lat_e5"))
    return fixes(spark, sf_dir).select("flight_id", "event_id", geo.tile_index(x, zoom).alias("x"), geo.tile_index(y, zoom).alias("y"), F.round(geo.degrees("lat_e5"), 5).alias("lat"))


@query("""SELECT c_custkey AS user_id, CASE WHEN row_number() OVER (PARTITION BY lower(c_mktsegment), c_nationkey ORDER BY c_custkey) > 1 THEN c_mktsegment || ' (#' || c_custkey || ')' ELSE c_mktsegment END AS name,
lower(trim('  ' || c_name || ' ')) AS email FROM customer""")
def users_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of another system: normalised addresses, and names that are taken get the key."""
    taken = F.row_number().over(W.partitionBy(F.lower("c_mktsegment"), "c_nationkey").orderBy("c_custkey")) > 1
    users = table(spark, sf_dir, "customer").withColumn("taken", taken)
    name = text.full_name(F.lit(None).cast("string"), F.col("c_mktsegment"), F.col("c_name"))
    return users.select(F.col("c_custkey").alias("user_id"), text.told_apart(name, F.col("c_custkey"), F.col("taken")).alias("name"), text.email(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("email"))


@query("""SELECT o_orderkey AS flight_id, strftime(to_timestamp(CAST(floor(epoch(o_orderdate)) AS BIGINT) + 7200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS local_time, printf('%02d:%02d', o_custkey * 7 // 3600, o_custkey * 7 // 60 % 60) AS duration,
CASE WHEN o_custkey < 1000 THEN o_custkey || ' m' ELSE printf('%.1f km', floor(o_custkey / 100.0 + 0.5) / 10) END AS distance, round(o_custkey::DOUBLE * 3.280839895::DOUBLE, 3) AS feet FROM orders""")
def flights_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at a fixed offset, durations, distances and converted units as texts."""
    f, key = flights(spark, sf_dir), F.col("user_id")
    metres = F.when(key < 1000, key).otherwise(F.floor(key / 100 + 0.5) * 100).cast("double")  # halves up, in either engine
    return f.select("flight_id", text.local_time_text(F.col("takeoff_at"), F.lit(7200)).alias("local_time"), text.duration_text(key * 7).alias("duration"), text.distance_text(metres).alias("distance"), F.round(text.converted(key.cast("double"), "m", "ft"), 3).alias("feet"))
