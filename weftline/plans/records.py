"""Queries over requests, rows and drafts: orders, customers and conversations stand in for jobs, posts and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import records as R
from weftline.plans.registry import query, table
from weftline.plans.timeline import TURNS, turns

K = "o_orderkey"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _both(expression: str) -> F.Column:
    """An expression that Spark and DuckDB read alike."""
    return F.expr(expression)


TRIM = {"a": f"CAST({K} % 700 AS DOUBLE) - 60", "b": f"CAST({K} * 7 % 900 AS DOUBLE) - 40", "len": f"CAST({K} % 450 AS DOUBLE) + 100"}
_TRIM = ", ".join(f"{x} AS {n}" for n, x in TRIM.items())


@query(f"""WITH r AS (SELECT {K}, {_TRIM} FROM orders), x AS (SELECT *, least(greatest(0, a), least(len, b)) AS s, greatest(greatest(0, a), least(len, b)) AS e FROM r),
    y AS (SELECT *, least(e, s + 179) AS t FROM x)
    SELECT {K}, CASE WHEN t > len THEN greatest(0, len - 179) ELSE s END AS start, CASE WHEN t > len THEN len ELSE t END AS "end",
    CASE WHEN b <= a THEN 'end_before_start' WHEN a < 0 THEN 'negative_start' WHEN b > len THEN 'end_after_source' WHEN b - a > 179 THEN 'too_long' END AS issue FROM y""")
def trim_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(_both(x).alias(n) for n, x in TRIM.items()))
    made = R.trim_range(F.col("a"), F.col("b"), F.col("len"))
    return rows.select(K, made["start"].alias("start"), made["end"].alias("end"), R.trim_issue(F.col("a"), F.col("b"), F.col("len")).alias("issue"))


REQUEST = {
    "lim": f"CASE {K} % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'many' WHEN 3 THEN '250' WHEN 4 THEN '-3' ELSE CAST({K} % 90 AS VARCHAR(9)) || '.7' END",
    "kind": f"CASE {K} % 4 WHEN 0 THEN ' Podcast ' WHEN 1 THEN 'talk' WHEN 2 THEN 'film' END",
    "url": f"CASE {K} % 7 WHEN 0 THEN '/data/a.mp4' WHEN 1 THEN 'HTTPS://a.org/x' WHEN 2 THEN 'ftp://a.org' WHEN 3 THEN 'http://' WHEN 4 THEN 'http://b.org' WHEN 5 THEN 'a.org' END",
    "batch": f"CASE WHEN {K} % 3 = 0 THEN ' b-' || CAST({K} AS VARCHAR(19)) WHEN {K} % 11 = 0 THEN '-bad' END",
    "monitor": f"CASE WHEN {K} % 5 = 0 THEN 'm_1' WHEN {K} % 13 = 0 THEN 'm 1' END",
    "rule": f"CASE WHEN {K} % 17 = 0 THEN 'r1' END",
    "asked": f"CASE {K} % 3 WHEN 0 THEN 'Batch' WHEN 1 THEN 'monitor ' ELSE 'robot' END",
}
_REQUEST = ", ".join(f"{x} AS {n}" for n, x in REQUEST.items())


@query(rf"""WITH r AS (SELECT {K}, {_REQUEST} FROM orders), n AS (SELECT *, CASE WHEN trim(lim) = '' THEN 0.0 ELSE coalesce(TRY_CAST(lim AS DOUBLE), 25) END AS n, CASE WHEN trim(lim) = '' THEN 0.0 ELSE coalesce(TRY_CAST(lim AS DOUBLE), 0) END AS o FROM r)
    SELECT {K}, CAST(greatest(1, least(100, floor(n))) AS INTEGER) AS "limit", CAST(greatest(0, floor(o)) AS BIGINT) AS "offset", CASE WHEN lower(trim(kind)) IN ('sermon', 'podcast', 'interview', 'talk', 'generic') THEN lower(trim(kind)) ELSE 'sermon' END AS kind,
    coalesce(starts_with(url, '/') OR regexp_matches(url, '(?i)^https?:/*[^/?#]'), false) AS valid, coalesce(regexp_matches(batch, '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$'), false) AS safe FROM n""")
def request_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(_both(x).alias(n) for n, x in REQUEST.items()))
    c = F.col
    return rows.select(K, R.page_limit(c("lim")).alias("limit"), R.page_offset(c("lim")).alias("offset"), R.content_type(c("kind")).alias("kind"), R.valid_source(c("url")).alias("valid"), R.safe_identifier(c("batch")).alias("safe"))


@query(rf"""WITH r AS (SELECT {K}, {_REQUEST} FROM orders), t AS (SELECT {K}, trim(coalesce(batch, '')) AS b, trim(coalesce(monitor, '')) AS m, trim(coalesce(rule, '')) AS u, lower(trim(asked)) AS a FROM r),
    i AS (SELECT *, CASE WHEN b <> '' AND NOT regexp_matches(b, '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$') THEN 'batch_id' WHEN m <> '' AND NOT regexp_matches(m, '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$') THEN 'monitor_id' WHEN u <> '' AND NOT regexp_matches(u, '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$') THEN 'monitor_rule_id' END AS issue FROM t)
    SELECT {K}, CASE WHEN issue IS NOT NULL THEN NULL WHEN m <> '' OR u <> '' THEN 'monitor' WHEN b <> '' THEN 'batch' WHEN a IN ('manual', 'batch', 'monitor') THEN a ELSE 'manual' END AS source, issue FROM i""")
def job_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(_both(x).alias(n) for n, x in REQUEST.items()))
    return rows.select(K, R.job_source(F.col("monitor"), F.col("rule"), F.col("batch"), F.col("asked")).alias("j")).select(K, "j.*")


CLAIM = {
    "id": f"CASE WHEN {K} % 9 = 0 THEN '  ' ELSE ' j' || CAST({K} AS VARCHAR(19)) END", "source_url": f"CASE WHEN {K} % 2 = 0 THEN 'http://a/' || CAST({K} AS VARCHAR(19)) END",
    "youtube_url": f"CASE WHEN {K} % 3 = 0 THEN 'http://y/' || CAST({K} AS VARCHAR(19)) END", "organization_id": f"CASE WHEN {K} % 7 <> 0 THEN 'o' || CAST(o_custkey AS VARCHAR(19)) END", "claim_token": f"CASE WHEN {K} % 4 = 0 THEN 't' END",
}
_CLAIM = ", ".join(f"{x} AS {n}" for n, x in CLAIM.items())


@query(f"""WITH r AS (SELECT {_CLAIM} FROM orders) SELECT trim(id) AS id, coalesce(source_url, youtube_url) AS source_url, organization_id, claim_token FROM r WHERE trim(id) <> '' AND coalesce(source_url, youtube_url) IS NOT NULL AND organization_id IS NOT NULL""")
def claim_row_checks(spark: SparkSession, d: str) -> DataFrame:
    return R.claim_rows(orders(spark, d).select(*(_both(x).alias(n) for n, x in CLAIM.items())))


PLACE = {
    "id": K, "organization_id": f"CASE WHEN {K} % 7 <> 0 THEN ' o  ' || CAST(o_custkey AS VARCHAR(19)) ELSE ' ' END", "client_id": f"CASE WHEN {K} % 2 = 0 THEN 'c 1 ' END", "name": f"CASE WHEN {K} % 3 = 0 THEN ' N ' WHEN {K} % 3 = 1 THEN '' END",
    "destination_type": f"CASE {K} % 5 WHEN 0 THEN 'WordPress ' WHEN 1 THEN 'ghost' WHEN 2 THEN 'webhook' WHEN 3 THEN 'mail' END", "enabled": f"CASE WHEN {K} % 4 = 0 THEN false WHEN {K} % 4 = 1 THEN true END", "publish_mode": f"CASE WHEN {K} % 2 = 0 THEN 'publish' ELSE 'Publish' END",
}
_PLACE = ", ".join(f"{x} AS {n}" for n, x in PLACE.items())


@query(rf"""WITH r AS (SELECT {_PLACE} FROM orders), c AS (SELECT id, trim(regexp_replace(organization_id, '\s+', ' ', 'g')) AS organization_id, coalesce(nullif(trim(client_id), ''), 'default') AS client_id, nullif(trim(coalesce(name, '')), '') AS name, lower(trim(destination_type)) AS destination_type, coalesce(enabled, true) AS enabled, CASE WHEN publish_mode = 'publish' THEN 'publish' ELSE 'draft' END AS publish_mode FROM r)
    SELECT * FROM c WHERE destination_type IN ('wordpress', 'ghost', 'webhook') AND organization_id <> ''""")
def destination_row_checks(spark: SparkSession, d: str) -> DataFrame:
    return R.destination_rows(orders(spark, d).select(*(_both(x).alias(n) for n, x in PLACE.items())))


ERROR = f"CASE {K} % 6 WHEN 0 THEN 'ffmpeg: Moov atom NOT found' WHEN 1 THEN 'Unsupported codec x' WHEN 2 THEN 'there is no unique constraint for ON CONFLICT' WHEN 3 THEN 'column Source_Clip_Key' WHEN 4 THEN 'timeout' END"
CODE = f"CASE {K} % 5 WHEN 0 THEN ' 42703' WHEN 1 THEN '42P10' WHEN 2 THEN '23505' END"


@query(f"""WITH r AS (SELECT {K}, lower(coalesce({ERROR}, '')) AS m, lower(trim(coalesce({CODE}, ''))) AS c, CASE WHEN {K} % 2 = 0 THEN ' Hoy: ' END AS p, CASE WHEN {K} % 3 = 0 THEN '(2) ' ELSE '' END AS s, trim(o_orderpriority) AS t FROM orders)
    SELECT {K}, contains(m, 'moov atom not found') OR contains(m, 'unsupported codec') AS retry, c IN ('42703', '42p10') OR contains(m, 'source_clip_key') OR contains(m, 'on conflict') AS key_error,
    CASE WHEN p IS NULL THEN '' ELSE 'Hoy: ' END || t || CASE WHEN s = '' THEN '' ELSE ' (2)' END AS title FROM r""")
def error_classes_and_titles(spark: SparkSession, d: str) -> DataFrame:
    title = R.mapped_title(F.expr(f"CASE WHEN {K} % 2 = 0 THEN ' Hoy: ' END"), F.trim("o_orderpriority"), F.expr(f"CASE WHEN {K} % 3 = 0 THEN '(2) ' ELSE '' END"))
    return orders(spark, d).select(K, R.retry_render(F.expr(ERROR)).alias("retry"), R.key_schema_error(F.expr(CODE), F.expr(ERROR)).alias("key_error"), title.alias("title"))


MEDIA = {"o": f"CASE WHEN {K} % 11 <> 0 THEN CAST({K} % 500 + 100 AS DOUBLE) END", "h": f"CASE WHEN {K} % 3 <> 0 AND {K} % 7 <> 0 THEN CAST({K} % 500 + 100 - {K} % 9 AS DOUBLE) END", "l": f"CASE WHEN {K} % 13 <> 0 THEN CAST({K} % 500 + 100 - {K} % 15 AS DOUBLE) END", "has": f"{K} % 3 <> 0"}
_MEDIA = ", ".join(f"{x} AS {n}" for n, x in MEDIA.items())


@query(f"""WITH r AS (SELECT {K}, {_MEDIA} FROM orders), x AS (SELECT *, has AND coalesce(h / o < 0.98::DOUBLE, false) AS hs, coalesce(l / coalesce(h, o) < 0.98::DOUBLE, false) AS ls FROM r)
    SELECT {K}, NOT (has AND (h IS NULL OR hs)) AS better_valid, l IS NOT NULL AND NOT ls AS light_valid, array_to_string(list_filter([CASE WHEN o IS NULL THEN 'no_original' END, CASE WHEN has AND h IS NULL THEN 'no_better' END, CASE WHEN l IS NULL THEN 'no_light' END, CASE WHEN hs THEN 'better_short' END, CASE WHEN ls THEN 'light_short' END], lambda v: v IS NOT NULL), ',') AS issues FROM x""")
def media_integrity(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(_both(x).alias(n) for n, x in MEDIA.items()))
    found = R.media_issues(F.col("o"), F.col("h"), F.col("l"), F.col("has"))
    return rows.select(K, found["better_valid"].alias("better_valid"), found["light_valid"].alias("light_valid"), F.array_join(found["issues"], ",").alias("issues"))


LINK = "CASE page_id % 4 WHEN 0 THEN 'https://drive.google.com/file/d/aB_' || CAST(page_id AS VARCHAR(19)) || '/view' WHEN 1 THEN 'https://drive.google.com/open?x=1&id=z-' || CAST(page_id AS VARCHAR(19)) || '#a' ELSE url END"


@query(rf"""WITH r AS (SELECT page_id, {LINK} AS u, url FROM pages), s AS (SELECT *, array_to_string(list_transform(list_filter(string_split(coalesce(url, ''), '/'), lambda x: x <> ''), lambda x: replace(replace(replace(replace(replace(url_encode(x), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')), '/') AS path,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS token FROM r)
    SELECT page_id, coalesce(nullif(regexp_extract(u, '/file/d/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]id=([a-zA-Z0-9_-]+)', 1), '')) AS drive, path, CASE WHEN token = '' THEN 'item' ELSE token END AS token, coalesce(starts_with(url, '/') OR regexp_matches(url, '(?i)^\s*https?:/*[^/?#\s]'), false) AS valid FROM s""")
def links_and_paths(spark: SparkSession, d: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return table(spark, d, "pages").select("page_id", R.drive_id(F.expr(LINK)).alias("drive"), R.storage_path(url).alias("path"), R.safe_token(url).alias("token"), R.valid_source(F.col("url")).alias("valid"))


DRAFT = {
    "job": f"lpad(CAST({K} AS VARCHAR(19)), 12, '0')", "title": f"CASE WHEN {K} % 3 = 0 THEN ' fe,  coraje y ' || lower(o_orderpriority) WHEN {K} % 3 = 1 THEN '' END", "seo_title": f"CASE WHEN {K} % 4 = 0 THEN 'seo título ' || CAST({K} AS VARCHAR(19)) END",
    "excerpt": f"CASE WHEN {K} % 5 <> 0 THEN repeat('abc ', CAST({K} % 200 AS INTEGER)) END", "slug": f"CASE WHEN {K} % 6 = 0 THEN 'Mi Página!' WHEN {K} % 6 = 1 THEN '¡¿' END", "seo_description": f"CASE WHEN {K} % 7 = 0 THEN 'd ' || o_orderpriority END",
    "focus_keyword": f"CASE WHEN {K} % 8 = 0 THEN 'clave' END", "tags": f"CASE WHEN {K} % 2 = 0 THEN 'fe, , esperanza y amor ,' || o_orderpriority || repeat(', más', CAST({K} % 15 AS INTEGER)) END",
    "scripture_refs": f"CASE WHEN {K} % 3 = 0 THEN 'Santiago 1:2-4, Romanos 5:3-5, ab' || repeat(', Juan 3:16', CAST({K} % 12 AS INTEGER)) END", "url": f"CASE WHEN {K} % 2 = 0 THEN 'https://youtu.be/' || lpad(CAST({K} AS VARCHAR(19)), 11, 'x') END", "confidence": f"CASE {K} % 4 WHEN 0 THEN '0.9' WHEN 1 THEN '7' WHEN 2 THEN 'high' END",
}
_DRAFT = ", ".join(f"{x} AS {n}" for n, x in DRAFT.items())
_LIST = lambda c: rf"list_transform(list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: substr(x, 1, 80))"


@query(rf"""WITH r AS (SELECT {_DRAFT} FROM orders), t AS (SELECT *, substr(coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')), ''), seo_title, 'Sermón de esperanza y fe'), 1, 140) AS t0 FROM r), u AS (SELECT *, upper(substr(t0, 1, 1)) || substr(t0, 2) AS tt FROM t),
    v AS (SELECT *, coalesce(nullif(substr(trim(regexp_replace(coalesce(excerpt, ''), '\s+', ' ', 'g')), 1, 320), ''), 'Reflexión basada en el sermón: ' || tt) AS ex, {_LIST('tags')}[1:10] AS tg, list_filter({_LIST('scripture_refs')}, lambda x: length(x) >= 3)[1:8] AS rf,
        regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(coalesce(slug, tt))), '[^a-z0-9\s-]', ' ', 'g')), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM u)
    SELECT job, tt AS title, CASE WHEN sl = '' THEN 'sermon-post' ELSE sl END || '-' || substr(job, 1, 8) AS slug, ex AS excerpt, coalesce(seo_title, tt) AS seo_title, coalesce(seo_description, ex) AS seo_description, coalesce(focus_keyword, tg[1], 'sermón cristiano') AS keyword, array_to_string(tg, '|') AS tags, array_to_string(rf, '|') AS refs,
    coalesce(regexp_extract(url, 'youtu\.be/([A-Za-z0-9_-]{{11}})', 1), '') AS video, CASE WHEN TRY_CAST(confidence AS DOUBLE) IS NULL THEN 0.65::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, TRY_CAST(confidence AS DOUBLE))) END AS confidence, 0 AS issues FROM v""")
def draft_defaults(spark: SparkSession, d: str) -> DataFrame:
    made = R.drafts(orders(spark, d).select(*(_both(x).alias(n) for n, x in DRAFT.items())))
    return made.withColumns({"tags": F.array_join("tags", "|"), "refs": F.array_join("refs", "|"), "issues": F.size("issues")})


_HTML = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(rf"""WITH {TURNS}, m AS (SELECT key, id, CASE id % 5 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '### ' WHEN 3 THEN '- ' ELSE '' END || text || chr(10) || '- "a" < b' || chr(10) || chr(10) || '  it''s & so ' AS md FROM turns),
    b AS (SELECT key, id, list_filter(list_transform(string_split(md, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bs FROM m)
    SELECT key, id, array_to_string(list_transform(bs, lambda x: CASE WHEN starts_with(x, '### ') THEN '<h3>' || {_HTML('substr(x, 5)')} || '</h3>' WHEN starts_with(x, '## ') THEN '<h2>' || {_HTML('substr(x, 4)')} || '</h2>' WHEN starts_with(x, '# ') THEN '<h1>' || {_HTML('substr(x, 3)')} || '</h1>'
        WHEN starts_with(x, '- ') THEN '<ul>' || array_to_string(list_transform(list_filter(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: starts_with(y, '- ')), lambda y: '<li>' || {_HTML('substr(y, 3)')} || '</li>'), '') || '</ul>'
        ELSE '<p>' || replace({_HTML('x')}, chr(10), '<br/>') || '</p>' END), chr(10)) AS html FROM b""")
def markdown_to_html(spark: SparkSession, d: str) -> DataFrame:
    mark = F.expr("CASE id % 5 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '### ' WHEN 3 THEN '- ' ELSE '' END")
    return turns(spark, d).select("key", "id", R.markdown_html(F.concat(mark, "text", F.lit("\n- \"a\" < b\n\n  it's & so "))).alias("html"))


BASE = f"""'{{"title":"t","a":{{"x":1,"y":{{"z":[1,2]}}}},"n":' || CAST({K} AS VARCHAR(19)) || '}}'"""
PATCH = f"""CASE {K} % 4 WHEN 0 THEN '{{"a":{{"y":{{"z":[3],"w":true}},"q":"é"}},"status":"done"}}' WHEN 1 THEN '{{"a":5,"last_error":"e","title":"new"}}' WHEN 2 THEN '{{"n":{{"deep":{{"er":1.5}}}}}}' ELSE '{{}}' END"""


PATHS = {"m_title": "$.title", "a": "$.a.x", "az": "$.a.y.z", "aw": "$.a.y.w", "q": "$.a.q", "n": "$.n.deep.er", "m_status": "$.status", "m_error": "$.last_error"}
_PATHS = ", ".join(f"json_merge_patch({BASE}, {PATCH})->>'{x}' AS {n}" for n, x in PATHS.items())


@query(f"""SELECT {K}, {_PATHS}, ({PATCH})->>'$.title' AS title, ({PATCH})->>'$.status' AS status, ({PATCH})->>'$.last_error' AS last_error,
    array_to_string(list_sort(list_filter(json_keys(({PATCH})::JSON), lambda x: x NOT IN ('title', 'status', 'last_error'))), ',') AS rest FROM orders""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, _both(BASE).alias("base"), _both(PATCH).alias("patch"))
    out = rows.select(K, R.merged_json("base", "patch").alias("merged"), R.routed_patch(F.col("patch")).alias("r"))
    found = [F.get_json_object("merged", x).alias(n) for n, x in PATHS.items()]
    return out.select(K, *found, "r.title", "r.status", "r.last_error", F.array_join(F.array_sort(F.map_keys("r.rest")), ",").alias("rest"))


@query(rf"""WITH {TURNS}, t AS (SELECT key, list(text ORDER BY id)[1:16] AS l, list(text ORDER BY id)[1:2] AS c FROM turns GROUP BY key), b AS (SELECT key, array_to_string(list_filter(l, lambda x: x <> ''), ' ') AS body, c FROM t)
    SELECT key, '## T' || key || chr(10) || chr(10) || '### Resumen del mensaje' || chr(10) || CASE WHEN body = '' THEN 'Contenido generado automáticamente desde la transcripción del sermón.' ELSE body END || CASE WHEN key % 2 = 0 THEN chr(10) || chr(10) || '### Momentos clave' || chr(10) || array_to_string(list_transform(c, lambda x: '- **Punto principal**' || CASE WHEN x = '' THEN '' ELSE ': ' || x END), chr(10)) ELSE '' END AS markdown FROM b""")
def fallback_posts(spark: SparkSession, d: str) -> DataFrame:
    packed = turns(spark, d).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("l"))
    clips = F.transform(F.slice("l", 1, 2), lambda x: F.struct(F.lit(" ").alias("title"), x.alias("excerpt")))
    some = F.when(F.col("key") % 2 == 0, clips).otherwise(F.slice(clips, 1, 0))
    return packed.select("key", R.fallback_markdown(F.concat(F.lit("T"), F.col("key").cast("string")), F.col("l"), some).alias("markdown"))


@query(f"""SELECT {K}, round(CASE WHEN {K} % 3 = 0 THEN 0.0 ELSE ({K} % 100)::DOUBLE END + CASE WHEN {K} % 5 = 0 THEN 0.0 ELSE ({K} * 1000)::DOUBLE / 1000000000.0::DOUBLE END, 9) AS seconds FROM orders""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col(K) % 3 != 0, (F.col(K) % 100).cast("double"))
    n = F.when(F.col(K) % 5 != 0, (F.col(K) * 1000).cast("double"))
    return orders(spark, d).select(K, F.round(R.seconds_of(s, n), 9).alias("seconds"))
