"""Checks and defaults of requests, rows and drafts as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.text import clean, escape_html, references, slug, string_list, video_id
from weftline.functions.values import clamp, finite

# Limits, shapes and names that requests and rows are checked against.
LONGEST_TRIM = 179.0
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
CONTENT_TYPES = ["sermon", "podcast", "interview", "talk", "generic"]
SOURCES = ["manual", "batch", "monitor"]
DESTINATIONS = ["wordpress", "ghost", "webhook"]
RETRY_MESSAGES = [
    "moov atom not found", "invalid data found when processing input", "could not find codec parameters", "error while opening decoder",
    "error initializing output stream", "cannot determine format", "unsupported codec",
]
KEY_ERROR_CODES = ["42703", "42p10"]
KEY_ERROR_MESSAGES = ["source_clip_key", "on conflict"]
TOP_LEVEL_FIELDS = ["title", "status", "last_error"]
DRAFT_TITLE = "Sermón de esperanza y fe"
DRAFT_EXCERPT = "Reflexión basada en el sermón: "
DRAFT_KEYWORD = "sermón cristiano"
NO_TRANSCRIPT = "Contenido generado automáticamente desde la transcripción del sermón."


def trim_range(start: Column, end: Column, source: Column) -> Column:
    """Struct (start, end) of a cut inside a source: borders swapped if they are the wrong way round, cut to the longest length."""
    low, high = F.greatest(F.lit(0.0), start), F.least(source, end)
    a, b = F.least(low, high), F.greatest(low, high)
    b = F.least(b, a + LONGEST_TRIM)
    over = b > source
    return F.struct(F.when(over, F.greatest(F.lit(0.0), source - LONGEST_TRIM)).otherwise(a).alias("start"), F.when(over, source).otherwise(b).alias("end"))


def trim_issue(start: Column, end: Column, source: Column) -> Column:
    """What is wrong with a cut; null if nothing is."""
    return (
        F.when(~finite(start) | ~finite(end), "invalid")
        .when(end <= start, "end_before_start")
        .when(start < 0, "negative_start")
        .when(end > source, "end_after_source")
        .when(end - start > LONGEST_TRIM, "too_long")
    )


def _number(text: Column, fallback: int) -> Column:
    """A parameter as a number: the fallback if it is absent or no number, 0 if it is blank."""
    n = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))
    return F.when(finite(n), n).otherwise(F.lit(float(fallback)))


def page_limit(text: Column, fallback: int = 25) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), F.floor(_number(text, fallback)))).cast("int")


def page_offset(text: Column, fallback: int = 0) -> Column:
    return F.greatest(F.lit(0), F.floor(_number(text, fallback))).cast("long")


def safe_identifier(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(IDENTIFIER)


def content_type(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(CONTENT_TYPES), t).otherwise(F.lit(CONTENT_TYPES[0]))


def valid_source(url: Column) -> Column:
    """An http or https url, or an absolute path."""
    u = F.coalesce(url, F.lit(""))
    return u.startswith("/") | u.startswith("\\") | u.rlike(r"(?i)^\s*https?:[/\\]*[^/\\?#\s]")


def job_source(monitor: Column, rule: Column, batch: Column, requested: Column) -> Column:
    """Struct (source, issue): monitor before batch before what was asked for before manual; the issue names the first odd id."""
    m, r, b = (F.trim(F.coalesce(x, F.lit(""))) for x in (monitor, rule, batch))
    asked = F.lower(F.trim(F.coalesce(requested, F.lit(""))))
    odd = lambda x, name: F.when((x != "") & ~safe_identifier(x), F.lit(name))
    issue = F.coalesce(odd(b, "batch_id"), odd(m, "monitor_id"), odd(r, "monitor_rule_id"))
    source = F.when((m != "") | (r != ""), "monitor").when(b != "", "batch").when(asked.isin(SOURCES), asked).otherwise("manual")
    return F.struct(F.when(issue.isNull(), source).alias("source"), issue.alias("issue"))


def claim_rows(rows: DataFrame) -> DataFrame:
    """id, source_url, organization_id, claim_token of the rows that have the first three; an older column youtube_url stands in for source_url."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = rows.select(text(F.col("id")).alias("id"), text(F.coalesce("source_url", "youtube_url")).alias("source_url"), text(F.col("organization_id")).alias("organization_id"), "claim_token")
    return out.where("id <> '' and source_url <> '' and organization_id <> ''")


def destination_rows(rows: DataFrame) -> DataFrame:
    """Rows of a known type with an organization, the other columns with their defaults."""
    text = lambda c: clean(F.col(c))
    out = rows.select(
        "id", text("organization_id").alias("organization_id"), F.coalesce(F.nullif(text("client_id"), F.lit("")), F.lit("default")).alias("client_id"), F.nullif(text("name"), F.lit("")).alias("name"),
        F.lower(text("destination_type")).alias("destination_type"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.when(text("publish_mode") == "publish", "publish").otherwise("draft").alias("publish_mode"),
    )
    return out.where(F.col("destination_type").isin(DESTINATIONS) & (F.col("organization_id") != ""))


def mapped_title(prefix: Column, title: Column, suffix: Column) -> Column:
    """The title between prefix and suffix, where there are any; the title itself if that would be empty."""
    p, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (prefix, suffix))
    whole = F.trim(F.concat(p, F.when(p != "", F.lit(" ")).otherwise(F.lit("")), title, F.when(s != "", F.concat(F.lit(" "), s)).otherwise(F.lit(""))))
    return F.when(whole == "", title).otherwise(whole)


def _says(message: Column, parts: list[str]) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for part in parts:
        out = out | m.contains(part)
    return out


def retry_render(message: Column) -> Column:
    """Whether an error says that the file can't be read, so that the better copy should be tried."""
    return _says(message, RETRY_MESSAGES)


def key_schema_error(code: Column, message: Column) -> Column:
    return F.lower(F.trim(F.coalesce(code, F.lit("")))).isin(KEY_ERROR_CODES) | _says(message, KEY_ERROR_MESSAGES)


def media_issues(original: Column, better: Column, light: Column, has_better: Column, least: float = 0.98) -> Column:
    """Struct (better_valid, light_valid, issues) of the lengths of copies: those that are unknown or shorter than ``least`` of their source.

    The light copy is measured against the better one, or against the original where there is none.
    """
    short = lambda copy, source: F.coalesce(copy / source < least, F.lit(False))
    reference = F.coalesce(better, original)
    issues = F.array_compact(
        F.array(
            F.when(original.isNull(), "no_original"), F.when(has_better & better.isNull(), "no_better"), F.when(light.isNull(), "no_light"),
            F.when(has_better & short(better, original), "better_short"), F.when(short(light, reference), "light_short"),
        )
    )
    return F.struct(
        (~(has_better & (better.isNull() | short(better, original)))).alias("better_valid"), (light.isNotNull() & ~short(light, reference)).alias("light_valid"), issues.alias("issues")
    )


def seconds_of(seconds: Column, nanos: Column) -> Column:
    return F.when(finite(seconds), seconds).otherwise(F.lit(0.0)) + F.when(finite(nanos), nanos / 1e9).otherwise(F.lit(0.0))


def drive_id(url: Column) -> Column:
    """The id of a shared file, from ``/file/d/<id>`` or else ``id=<id>``; null without."""
    part = lambda rx: F.nullif(F.regexp_extract(url, rx, 1), F.lit(""))
    return F.coalesce(part(r"/file/d/([a-zA-Z0-9_-]+)"), part(r"[?&]id=([a-zA-Z0-9_-]+)"))


def storage_path(path: Column) -> Column:
    """The parts of a path, empty ones left out, each with all but letters, digits and - _ . ! ~ * ' ( ) as percent codes."""

    def encoded(x: Column) -> Column:
        out = F.url_encode(x)
        for a, b in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), encoded), "/")


def safe_token(value: Column, fallback: str = "item") -> Column:
    """A text as part of a file name: other characters become one underscore, ends are trimmed."""
    token = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    token = F.regexp_replace(token, "^[._-]+|[._-]+$", "")
    return F.when(token == "", F.lit(fallback)).otherwise(token)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def markdown_html(markdown: Column) -> Column:
    """Blocks of Markdown (headings of three levels, lists, paragraphs) as HTML, one a line."""

    def block(x: Column) -> Column:
        tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
        entries = F.filter(F.transform(F.split(x, "\n"), _stripped), lambda y: y.startswith("- "))
        bullets = F.array_join(F.transform(entries, lambda y: tag("li", escape_html(F.substr(y, F.lit(3))))), "")
        return (
            F.when(x.startswith("### "), tag("h3", escape_html(F.substr(x, F.lit(5)))))
            .when(x.startswith("## "), tag("h2", escape_html(F.substr(x, F.lit(4)))))
            .when(x.startswith("# "), tag("h1", escape_html(F.substr(x, F.lit(3)))))
            .when(x.startswith("- "), tag("ul", bullets))
            .otherwise(tag("p", F.replace(escape_html(x), F.lit("\n"), F.lit("<br/>"))))
        )

    blocks = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n\n"), _stripped), lambda x: x != "")
    return F.array_join(F.transform(blocks, block), "\n")


def _merged(base: object, patch: object) -> object:
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    return base | {k: _merged(base.get(k), v) for k, v in patch.items()}


@F.pandas_udf(StringType())
def merged_json(base: pd.Series, patch: pd.Series) -> pd.Series:
    """Two JSON objects as one: objects inside are merged, anything else is replaced. Null counts as an empty object."""
    return pd.Series([json.dumps(_merged(json.loads(a or "{}"), json.loads(b or "{}")), separators=(",", ":"), ensure_ascii=False) for a, b in zip(base, patch, strict=True)])


def routed_patch(patch: Column) -> Column:
    """Struct of the fields that a job has columns for (null where the patch has none) and ``rest``, a map of the others (name to JSON text)."""
    names = F.json_object_keys(patch)
    fields = [F.get_json_object(patch, f"$.{n}").alias(n) for n in TOP_LEVEL_FIELDS]
    others = F.filter(names, lambda n: ~n.isin(TOP_LEVEL_FIELDS))
    all_ = F.from_json(patch, "map<string,string>")
    return F.struct(*fields, F.map_filter(all_, lambda k, _: F.array_contains(others, k)).alias("rest"))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def drafts(rows: DataFrame) -> DataFrame:
    """Posts from raw drafts: job, title, slug, excerpt, seo_title, seo_description, keyword, tags, refs, video, confidence, issues.

    rows: job, title, seo_title, excerpt, slug, seo_description, focus_keyword, tags, scripture_refs (texts), url, confidence (text).
    """
    text = lambda c: clean(F.col(c))
    filled = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other)
    title = sentence_case(F.substring(filled(text("title"), filled(text("seo_title"), F.lit(DRAFT_TITLE))), 1, 140))
    out = rows.withColumn("_title", title).withColumn("_excerpt", filled(F.substring(text("excerpt"), 1, 320), F.concat(F.lit(DRAFT_EXCERPT), F.col("_title"))))
    out = out.withColumn("_tags", F.slice(string_list(F.col("tags")), 1, 10)).withColumn("_slug", F.concat(slug(filled(text("slug"), F.col("_title")), "sermon-post"), F.lit("-"), F.substring("job", 1, 8)))
    confidence = F.col("confidence").try_cast("double")
    issues = F.array_compact(F.array(F.when(~F.col("_slug").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "invalid_slug"), F.when(F.col("_title") == "", "missing_title")))
    return out.select(
        "job", F.col("_title").alias("title"), F.col("_slug").alias("slug"), F.col("_excerpt").alias("excerpt"),
        filled(F.substring(text("seo_title"), 1, 170), F.col("_title")).alias("seo_title"), filled(F.substring(text("seo_description"), 1, 260), F.col("_excerpt")).alias("seo_description"),
        filled(F.substring(text("focus_keyword"), 1, 120), F.coalesce(F.get("_tags", F.lit(0)), F.lit(DRAFT_KEYWORD))).alias("keyword"),
        F.col("_tags").alias("tags"), references(F.col("scripture_refs")).alias("refs"), video_id(F.coalesce("url", F.lit(""))).alias("video"),
        F.when(finite(confidence), clamp(confidence, 0.0, 1.0)).otherwise(F.lit(0.65)).alias("confidence"), issues.alias("issues"),
    )


def fallback_markdown(title: Column, texts: Column, clips: Column) -> Column:
    """A post from a title, an array of texts in order (16 are used) and an array of (title, excerpt) of clips (5 are used)."""
    body = F.array_join(F.filter(F.transform(F.slice(texts, 1, 16), clean), lambda x: x != ""), " ")
    entry = lambda c: F.concat(
        F.lit("- **"), F.coalesce(F.nullif(clean(c["title"]), F.lit("")), F.lit("Punto principal")), F.lit("**"), F.when(clean(c["excerpt"]) != "", F.concat(F.lit(": "), clean(c["excerpt"]))).otherwise(F.lit(""))
    )
    moments = F.when(F.size(clips) > 0, F.concat(F.lit("\n\n### Momentos clave\n"), F.array_join(F.transform(F.slice(clips, 1, 5), entry), "\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("## "), title, F.lit("\n\n### Resumen del mensaje\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit(NO_TRANSCRIPT)), moments)
