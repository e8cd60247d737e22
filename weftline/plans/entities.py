"""Queries over keyed tables: scores and choices, upserts, queues, tenants, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators import entity as E
from weftline.operators import folds, scoring
from weftline.operators import selection as P
from weftline.plans.registry import query, table
from weftline.plans.timeline import HOUR, TL, events, lasting, turns

NOW = 946_684_800_000_000  # 2000-01-01 in microseconds


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: id, organization_id, created_at, status, lease_expires_at, attempt_count, claim_token."""
    c = F.col
    status = F.when(c("o_orderstatus") == "P", "pending").when(c("o_orderstatus") == "O", F.concat(F.lit("processing:transcribe:"), (c("o_orderkey") % 120).cast("string"), F.lit("/120"))).otherwise(F.when(c("o_orderkey") % 2 == 0, "completed").otherwise(F.concat(F.lit("processing:ingest:download:"), (c("o_orderkey") % 100).cast("string"), F.lit("%"))))
    created = V.micros("o_orderdate")
    lease = F.when(c("o_orderkey") % 3 != 0, created + (c("o_orderkey") % 5) * 86_400_000_000)
    return orders(spark, d).select(c("o_orderkey").alias("id"), (c("o_custkey") % 10).alias("organization_id"), created.alias("created_at"), status.alias("status"), lease.alias("lease_expires_at"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("claim_token"))


JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey % 10 AS organization_id, epoch_us(o_orderdate) AS created_at,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'processing:transcribe:' || (o_orderkey % 120) || '/120' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'processing:ingest:download:' || (o_orderkey % 100) || '%' END AS status,
    CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) + (o_orderkey % 5) * 86400000000 END AS lease_expires_at FROM orders)"""


@query(f"""WITH {JOBS} SELECT id, created_at, status FROM jobs WHERE status = 'pending' OR (starts_with(status, 'processing') AND lease_expires_at IS NOT NULL AND lease_expires_at < {NOW}) ORDER BY created_at, id LIMIT 20""")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    return E.queue_head(jobs(spark, d), F.lit(NOW), 20).select("id", "created_at", "status")


@query(f"""WITH {JOBS} SELECT id, coalesce((status = 'pending' AND {NOW} - created_at > 60000000) OR (starts_with(status, 'processing') AND {NOW} > lease_expires_at), false) AS stale FROM jobs""")
def stale_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", V.is_stale(F.col("status"), F.col("created_at"), F.col("lease_expires_at"), F.lit(NOW)).alias("stale"))


@query(f"""WITH {JOBS}, p AS (SELECT id, status, CASE WHEN starts_with(status, 'processing:') THEN split_part(status, ':', 2) ELSE status END AS stage,
    CASE WHEN status LIKE '%/120' THEN (id % 120) * 100.0::DOUBLE / 120.0::DOUBLE WHEN status LIKE '%\\%' ESCAPE '\\' THEN (id % 100)::DOUBLE ELSE 0.0::DOUBLE END AS percent FROM jobs)
    SELECT id, stage, percent, CASE stage WHEN 'pending' THEN 0.0::DOUBLE WHEN 'completed' THEN 100.0::DOUBLE WHEN 'ingest' THEN 0 + percent / 100.0::DOUBLE * 15 ELSE 15 + percent / 100.0::DOUBLE * 25 END AS progress FROM p""")
def status_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return jobs(spark, d).select("id", V.status_stage(s).alias("stage"), V.status_percent(s).alias("percent"), V.status_progress(s).alias("progress"))


@query("""SELECT o_orderkey, o_totalprice, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderdate")
    return P.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 25)


@query("""SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(nullif(greatest(c_acctbal, 0), 0), 1.5) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def topn_coalesce_score(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(F.nullif(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0)), F.lit(1.5))
    return P.top(table(spark, d, "customer"), ["c_nationkey"], [F.desc(score), F.asc("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank")


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey, o_totalprice, CAST(quarter(o_orderdate) AS INTEGER) AS bucket FROM orders),
    s AS (SELECT *, row_number() OVER (PARTITION BY key, bucket ORDER BY o_totalprice DESC, o_orderkey) AS i, max(o_totalprice) OVER (PARTITION BY key, bucket) AS strength FROM r),
    p AS (SELECT key, o_orderkey, bucket, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN i <= 2 THEN 0 ELSE 1 END, CASE WHEN i <= 2 THEN strength END DESC NULLS LAST, CASE WHEN i <= 2 THEN bucket END NULLS LAST, o_totalprice DESC, o_orderkey) AS pick FROM s)
    SELECT key, o_orderkey, bucket, pick FROM p WHERE pick <= 6""")
def bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice", F.quarter("o_orderdate").alias("bucket"))
    return P.budget(rows, ["key"], "bucket", "o_totalprice", "o_orderkey", 2, 6).select("key", "o_orderkey", "bucket", "pick")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates: key, id, start, end, text, still, motion, score."""
    c = F.col("o_orderkey")
    base = orders(spark, d).select(F.col("o_custkey").alias("key"), c.alias("id"), (c % 3600).cast("double").alias("start"), ((c % 97) / 97.0).alias("text"), ((c % 53) / 400.0).alias("motion"), (c % 260).cast("double").alias("length"))
    return base.withColumn("end", F.col("start") + F.col("length")).withColumn("still", scoring.stillness(F.col("motion"))).withColumn("score", scoring.segment_score(F.col("text"), F.col("motion")))


CAND = """cand AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - motion / 0.12::DOUBLE)) AS still, 0.62::DOUBLE * text + 0.38::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - motion / 0.12::DOUBLE)) AS score, start + length AS "end" FROM
    (SELECT o_custkey AS key, o_orderkey AS id, (o_orderkey % 3600)::DOUBLE AS start, (o_orderkey % 97) / 97.0::DOUBLE AS text, (o_orderkey % 53) / 400.0::DOUBLE AS motion, (o_orderkey % 260)::DOUBLE AS length FROM orders))"""


@query(f"""WITH {CAND} SELECT id, length BETWEEN 2.5 AND 220 AND text >= 0.18 AND still >= 0.28 AND score >= 0.32 AS base, length >= 5 AND text >= 0.58 AND score >= 0.42 AS override FROM cand""")
def candidate_gates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    base, override = scoring.gates(c("length"), c("text"), c("still"), c("score"))
    return candidates(spark, d).select("id", base.alias("base"), override.alias("override"))


@query(f"""WITH {CAND}, p AS (SELECT id, 0.55::DOUBLE * score + 0.20::DOUBLE * text + 0.15::DOUBLE * still + 0.10::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(45.0::DOUBLE, "end" - start)) / 45.0::DOUBLE)) AS s, 0.5::DOUBLE * (start + "end") AS c FROM cand),
    q AS (SELECT id, s + CASE WHEN c >= 600 THEN 0.12::DOUBLE + 0.08::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c - 600) / 1800.0::DOUBLE)) WHEN 600 - c > 120 THEN -0.10::DOUBLE WHEN 600 - c > 45 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c - 3000 > 300 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END AS v FROM p)
    SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, v)), 6) AS priority FROM q""")
def priority_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return candidates(spark, d).select("id", scoring.priority(c("score"), c("text"), c("still"), c("start"), c("end"), 600.0, 3000.0).alias("priority"))


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS s, o_orderkey % 4 * 5000000 AS part FROM orders)
    SELECT key, arg_max(o_orderkey, (s, -o_orderkey)) AS winner, arg_max(o_orderkey, (s - part, -o_orderkey)) AS winner_without, arg_max(o_orderkey, (s, -o_orderkey)) <> arg_max(o_orderkey, (s - part, -o_orderkey)) AS changed FROM r GROUP BY key""")
def counterfactual_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("s"), (F.col("o_orderkey") % 4 * 5_000_000).alias("part"))
    return scoring.with_and_without(rows, ["key"], F.col("s"), F.col("part"), "o_orderkey", "o_orderkey")


@query("""WITH new AS (SELECT c_custkey, c_name || ' new' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'added', 5.0 FROM customer WHERE c_custkey % 7 = 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0) o FULL OUTER JOIN new n ON o.c_custkey = n.c_custkey""")
def upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    all_ = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = all_.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit(" new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = new.unionByName(all_.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("added").alias("c_name"), F.lit(5.0).alias("c_acctbal")))
    return E.upsert(all_.where("c_custkey % 2 = 0"), new, ["c_custkey"], keep=("c_acctbal",))


@query("""WITH old AS (SELECT o_custkey, o_orderkey, o_orderstatus AS status, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_custkey, o_orderkey, 'F' AS status, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0),
    kept AS (SELECT * FROM old o WHERE EXISTS (SELECT 1 FROM new n WHERE n.o_orderkey = o.o_orderkey AND n.o_custkey = o.o_custkey) OR NOT EXISTS (SELECT 1 FROM new n WHERE n.o_custkey = o.o_custkey) OR status <> 'P')
    SELECT * FROM new UNION ALL SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.o_orderkey = k.o_orderkey AND n.o_custkey = k.o_custkey)""")
def reconcile_anti(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    old = o.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("old").alias("v"))
    new = o.where("o_orderkey % 3 = 0 and o_custkey % 2 = 0").select("o_custkey", "o_orderkey", F.lit("F").alias("status"), F.lit("new").alias("v"))
    return E.reconcile(old, new, ["o_custkey", "o_orderkey"], ["o_custkey"], F.col("status") == "P")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD'))""")
def tenant_semi(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return E.visible(orders(spark, d), members, "7", ("MACHINERY", "HOUSEHOLD"), "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH prof AS (SELECT n_name AS client, n_nationkey AS setting FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'default', 100 UNION ALL SELECT 'default', 101), c AS (SELECT c_custkey, n_name AS client FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c.c_custkey, c.client, p.setting, p.client AS profile FROM c JOIN prof p ON p.client = CASE WHEN EXISTS (SELECT 1 FROM prof x WHERE x.client = c.client) THEN c.client ELSE 'default' END""")
def lookup_default_fallback(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    defaults = spark.createDataFrame([("default", 100), ("default", 101)], "client string, setting int")
    profiles = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("client"), F.col("n_nationkey").alias("setting")).unionByName(defaults)
    clients = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("client"))
    return E.with_default(clients, profiles, "client", "default").select("c_custkey", "client", "setting", "profile")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(orders(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT p_brand, arg_max(p_partkey, (p_retailprice, length(p_name), -p_partkey)) AS best FROM part GROUP BY p_brand""")
def representative_pick(spark: SparkSession, d: str) -> DataFrame:
    return P.arg_max(table(spark, d, "part"), ["p_brand"], F.col("p_partkey"), [F.col("p_retailprice"), F.length("p_name"), -F.col("p_partkey")])


@query("""SELECT event_id AS id, epoch_us(ts) AS start, 'a' AS lane FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, epoch_us(ts), 'b' FROM events WHERE event_type IN ('click', 'error')""")
def union_lanes(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    a = rows.where("label = 'view'").select("id", "start", F.lit("a").alias("lane"))
    b = rows.where("label in ('click', 'error')").select("id", "start", F.lit("b").alias("lane"))
    return a.unionByName(b).orderBy("start", "lane", "id")


@query("""WITH p AS (SELECT o_custkey AS key, min(o_orderkey % 600) AS p FROM orders GROUP BY o_custkey), a AS (SELECT key, p AS t, 0 AS o FROM p UNION ALL SELECT o.o_custkey, o.o_orderkey % 1200, 1 FROM orders o JOIN p ON p.key = o.o_custkey WHERE o.o_orderkey % 1200 BETWEEN p.p - 200 AND p.p + 900 AND abs(o.o_orderkey % 1200 - p.p) <= 400)
    SELECT DISTINCT key, CAST(t AS BIGINT) AS t FROM a""")
def candidate_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 1200).alias("t"), (F.col("o_orderkey") % 600).alias("p"))
    primary = rows.groupBy("key").agg(F.min("p").alias("t")).withColumn("low", F.col("t") - 200).withColumn("high", F.col("t") + 900)
    return P.sample_candidates(primary, rows.select("key", "t"), ["key"], "t", "low", "high", 400)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM e GROUP BY label, i)
    SELECT e.vec_id, e.label, round(sum(e.x::DOUBLE * c.m) / (sqrt(sum(e.x::DOUBLE * e.x)) * sqrt(sum(c.m * c.m))), 6) AS cosine FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY e.vec_id, e.label""")
def cosine_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))
    return rows.join(centers, "label").select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("center")), 6).alias("cosine"))


@query("""WITH c AS (SELECT o_custkey, list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(len(l), 0) AS n, array_to_string(list_transform(l, lambda x: x.s), ',') AS statuses FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def parent_children(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    found = E.children(table(spark, d, "customer").select("c_custkey"), rows, "c_custkey", ["o_orderkey"], ["o_orderstatus"], "orders")
    text = F.when(F.size("orders") > 0, F.array_join(F.transform("orders", lambda x: x["o_orderstatus"]), ","))
    return found.select("c_custkey", F.size("orders").alias("n"), text.alias("statuses"))


@query("""SELECT o_custkey AS worker, count(*) AS jobs, arg_max(o_orderkey, (o_orderstatus = 'O', o_orderdate, o_orderkey)) AS shown FROM orders GROUP BY o_custkey""")
def workers_view(spark: SparkSession, d: str) -> DataFrame:
    pick = F.max_by("o_orderkey", F.struct(F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey"))
    return orders(spark, d).groupBy(F.col("o_custkey").alias("worker")).agg(F.count("*").alias("jobs"), pick.alias("shown"))


@query("""SELECT o_custkey AS key, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price, count(*) AS n FROM orders GROUP BY o_custkey""")
def first_last_summary(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk FROM orders""")
def chunked_batches(spark: SparkSession, d: str) -> DataFrame:
    return P.chunks(orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


# --- folds: SQL has no short way to say these; tests compare them with hand-made cases --------------


@query(None)
def caption_builder(spark: SparkSession, d: str) -> DataFrame:
    words = turns(spark, d).select("key", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "text", "speaker", F.lit("word").alias("kind"))
    return folds.captions(words, ["key"])


def _slides(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return rows.select("key", "id", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6 + 2).alias("end"), F.concat(F.col("label"), F.lit(" slide")).alias("text"), (F.col("id") % 64).alias("hash"), (F.col("cents") / 1e5).alias("confidence"), F.col("label").alias("type"))


@query(None)
def slide_merge(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_similar(_slides(spark, d), ["key"], folds.MergeParams(gap=6 * 3600.0))


@query(None)
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return folds.duplicate_groups(_slides(spark, d), ["key"])


@query(None)
def fuse_tracks(spark: SparkSession, d: str) -> DataFrame:
    return folds.fuse(_slides(spark, d).withColumn("track", F.col("id") % 10), ["key"], "track")


@query(None)
def identity_clusters(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("key"), F.col("vec_id").alias("id"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector"))
    return folds.online_centroids(hits, ["key"])


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, d).select(F.col("o_custkey").alias("key"), k.alias("id"), F.quarter("o_orderdate").alias("t"), (k % 40).alias("x"), (k % 30).alias("y"), F.lit(20).alias("w"), F.lit(15).alias("h"), F.col("o_totalprice").alias("score"))


_BOXES = """b AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(quarter(o_orderdate) AS INTEGER) AS t, o_orderkey % 40 AS x, o_orderkey % 30 AS y, o_totalprice AS score FROM orders)"""


@query(f"""WITH RECURSIVE {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY key, t ORDER BY score DESC, id) AS n FROM b),
    w AS (SELECT DISTINCT key, t, 0::BIGINT AS n, []::STRUCT(x BIGINT, y BIGINT, id BIGINT)[] AS kept FROM r UNION ALL SELECT w.key, w.t, r.n, CASE WHEN len(list_filter(kept, lambda k: (greatest(0, 20 - abs(k.x - r.x)) * greatest(0, 15 - abs(k.y - r.y)))::DOUBLE / (600 - greatest(0, 20 - abs(k.x - r.x)) * greatest(0, 15 - abs(k.y - r.y))) >= 0.25)) = 0
        THEN list_append(kept, {{'x': r.x, 'y': r.y, 'id': r.id}}) ELSE kept END FROM w JOIN r ON r.key = w.key AND r.t = w.t AND r.n = w.n + 1), k AS (SELECT key, unnest(arg_max(kept, n)) AS b FROM w GROUP BY key, t)
    SELECT key, b.id AS id FROM k""")
def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    return folds.suppress_boxes(_boxes(spark, d), ["key"])


@query(None)
def box_tracks(spark: SparkSession, d: str) -> DataFrame:
    return folds.track_boxes(_boxes(spark, d), ["key"])


def _path(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("key", F.col("start").alias("t")).agg(F.max(F.col("cents") / 100).alias("x"))


PATH = """path AS (SELECT user_id AS key, epoch_us(ts) AS t, max(round(value * 100)) / 100 AS x FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n, row_number() OVER (PARTITION BY key ORDER BY t DESC) AS m FROM path)"""


@query(f"""WITH RECURSIVE {PATH}, f AS (SELECT key, n, x AS e FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, 0.65::DOUBLE * f.e + 0.35::DOUBLE * r.x FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1), g AS (SELECT key, m, x AS e FROM r WHERE m = 1 UNION ALL SELECT r.key, r.m, 0.65::DOUBLE * g.e + 0.35::DOUBLE * r.x FROM g JOIN r ON r.key = g.key AND r.m = g.m + 1)
    SELECT r.key, r.t, round((f.e + g.e) / 2 + 0.00000003::DOUBLE, 6) AS x, round(f.e + 0.00000003::DOUBLE, 6) AS forward FROM r JOIN f ON f.key = r.key AND f.n = r.n JOIN g ON g.key = r.key AND g.m = r.m""")
def zero_phase_ema(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, d)
    forward = folds.smooth(path, ["key"], both_ways=False).select("key", "t", F.round(F.col("x") + 3e-8, 6).alias("forward"))
    return folds.smooth(path, ["key"]).select("key", "t", F.round(F.col("x") + 3e-8, 6).alias("x")).join(forward, ["key", "t"])


@query(None)
def polyline_simplify(spark: SparkSession, d: str) -> DataFrame:
    return folds.simplify(_path(spark, d), ["key"], 25.0)


@query(f"""WITH RECURSIVE {PATH}, w AS (SELECT key, n, t, x AS o, 0 AS dir, 0 AS lasted FROM r WHERE n = 1
    UNION ALL SELECT key, n, t, o + CASE WHEN sign <> 0 AND CASE WHEN sign = dir THEN lasted + 1 ELSE 1 END >= 2 THEN greatest(-40.0::DOUBLE, least(40.0::DOUBLE, move)) ELSE 0.0::DOUBLE END, sign, CASE WHEN sign = dir THEN lasted + 1 ELSE 1 END
        FROM (SELECT r.key, r.n, r.t, w.o, w.dir, w.lasted, r.x - w.o AS move, CASE WHEN abs(r.x - w.o) <= 6 THEN 0 WHEN r.x > w.o THEN 1 ELSE -1 END AS sign FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)) SELECT key, t, round(o, 6) AS x FROM w""")
def motion_limit(spark: SparkSession, d: str) -> DataFrame:
    return folds.limit_motion(_path(spark, d), ["key"]).withColumn("x", F.round("x", 6))


@query("""WITH RECURSIVE s AS (SELECT user_id AS key, epoch_us(ts) AS t, max(round(value * 100)) / 30000 + CASE WHEN bool_or(event_type = 'error') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM s),
    w AS (SELECT key, n, t, v >= 0.5 AS "on" FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, r.t, r.v >= CASE WHEN w."on" THEN 0.35 ELSE 0.5 END FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1) SELECT key, t, "on" OR n % 10 = 0 AS selected, n % 10 = 0 AS forced FROM w""")
def hysteresis_gate(spark: SparkSession, d: str) -> DataFrame:
    samples = events(spark, d).groupBy("key", F.col("start").alias("t")).agg(F.max(F.col("cents") / 30000).alias("score"), F.max(F.col("label") == "error").alias("cut"))
    return folds.hysteresis(samples, ["key"])


@query(None)
def rescue_neighbours(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("id") * 37 % 280).cast("double")
    c = candidates(spark, d).withColumns({"priority": F.col("score"), "text_score": F.col("text"), "start": start, "end": start + 5.0})
    picked = P.budget(c.withColumn("bucket", F.floor(F.col("start") / 100)), ["key"], "bucket", "priority", "id", 1, 2).select("key", "id").withColumn("picked", F.lit(True))
    return folds.rescue_neighbours(c.join(picked, ["key", "id"], "left").fillna(False, ["picked"]), ["key"])


@query(f"""WITH RECURSIVE {TL.replace('43200000000', '3600000000')}, s AS (SELECT key, id, CASE label WHEN 'view' THEN 'congregational_music' WHEN 'click' THEN 'sermon' ELSE 'other' END AS type, (id % 10) / 10.0::DOUBLE AS music, (id % 7) / 7.0::DOUBLE AS speech, row_number() OVER (PARTITION BY key ORDER BY start, id) AS n FROM tl),
    x AS (SELECT *, lead(type) OVER (PARTITION BY key ORDER BY n) AS after, type = 'congregational_music' AND music < 0.12 AND speech > 0.7 AS odd FROM s),
    w AS (SELECT key, n, id, CASE WHEN odd THEN CASE WHEN after = 'sermon' THEN 'sermon' ELSE 'other' END ELSE type END AS type FROM x WHERE n = 1 UNION ALL SELECT x.key, x.n, x.id, CASE WHEN odd THEN CASE WHEN after = 'sermon' OR w.type = 'sermon' THEN 'sermon' ELSE 'other' END ELSE x.type END FROM w JOIN x ON x.key = w.key AND x.n = w.n + 1)
    SELECT key, id, type FROM w""")
def relabel_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d, HOUR).select("key", "id", "start", F.when(F.col("label") == "view", "congregational_music").when(F.col("label") == "click", "sermon").otherwise("other").alias("type"), ((F.col("id") % 10) / 10).alias("music"), ((F.col("id") % 7) / 7).alias("speech"), F.lit(False).alias("song_cue"))
    return folds.relabel(rows, ["key"])
