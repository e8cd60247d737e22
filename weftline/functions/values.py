"""Numbers, times, keys and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds in a second. Times are compared as whole microseconds and become seconds only in results.
SECOND = 1_000_000


def micros(timestamp: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    name = timestamp if isinstance(timestamp, str) else None
    column = F.col(name) if name else timestamp
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def fixed(x: Column, digits: int) -> Column:
    """The text of a double with so many decimals, rounded from its exact binary value."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def rounded(x: Column, digits: int) -> Column:
    return fixed(x, digits).cast("double")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, -1 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(-1.0))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes given as x, y, width, height."""
    wide = F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))


def clock_seconds(text: Column) -> Column:
    """H:MM:SS or MM:SS to seconds, anything else to 0."""
    parts = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    three = F.element_at(parts, 1) * 3600 + F.element_at(parts, 2) * 60 + F.try_element_at(parts, F.lit(3))
    two = F.element_at(parts, 1) * 60 + F.try_element_at(parts, F.lit(2))
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, two).otherwise(F.lit(0.0))


def _two(x: Column) -> Column:
    """At least two digits; lpad alone would cut longer numbers."""
    digits = x.cast("string")
    return F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, rounded down; more digits from 100 hours on."""
    s = F.floor(F.greatest(F.lit(0.0), seconds))
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def srt_clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm, starting again after 24 hours."""
    ms = F.floor(F.round(seconds * 1000)) % 86_400_000
    day = F.concat_ws(":", _two(F.floor(ms / 3_600_000)), _two(F.floor(ms % 3_600_000 / 60_000)), _two(F.floor(ms % 60_000 / 1000)))
    return F.concat(day, F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parts_key(*parts: Column, size: int) -> Column:
    """The first characters of the SHA-1 of the parts joined by pipes."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, size)


def clip_key(job: Column, start: Column, end: Column, title: Column, excerpt: Column, decimals: int = 3, size: int = 24) -> Column:
    """Deterministic key of a clip; null title and excerpt count as empty."""
    text = [F.trim(F.coalesce(x, F.lit(""))) for x in (title, excerpt)]
    return parts_key(job, fixed(start, decimals), fixed(end, decimals), *text, size=size)


def asset_id(job: Column, start: Column, end: Column, title: Column, excerpt: Column) -> Column:
    return F.concat(F.lit("clip_"), clip_key(job, start, end, title, excerpt, 2, 12))


def unfenced(text: Column) -> Column:
    """JSON without a Markdown fence around it."""
    return F.trim(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def first_present(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that is there."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


# --- job status -----------------------------------------------------------------------------------

# The part of the whole progress that each stage covers.
STAGES = {"ingest": (0, 15), "transcribe": (15, 40), "analyze": (40, 60), "render": (60, 85), "store": (85, 90), "blog": (90, 95), "delivery": (95, 99)}


def status_stage(status: Column) -> Column:
    return F.when(status.startswith("processing:"), F.split_part(status, F.lit(":"), F.lit(2))).otherwise(status)


def status_percent(status: Column) -> Column:
    """Percent inside the stage: ``x/y``, ``n%``, 0 if there is neither."""
    done, total = (F.regexp_extract(status, r"(\d+)/(\d+)$", k) for k in (1, 2))
    percent = F.regexp_extract(status, r"(\d+)%$", 1)
    share = F.when((total != "") & (total.try_cast("int") > 0), done.try_cast("double") * 100 / total.try_cast("double"))
    return F.coalesce(share, F.when(percent != "", percent.try_cast("double")), F.lit(0.0))


def status_progress(status: Column) -> Column:
    """0 to 100 over all stages."""
    out = F.when(status == "pending", F.lit(0.0)).when(status.isin("completed", "failed"), F.lit(100.0))
    for stage, (low, high) in STAGES.items():
        out = out.when(status_stage(status) == stage, low + status_percent(status) / 100 * (high - low))
    return out.otherwise(F.lit(0.0))


def is_stale(status: Column, created: Column, lease: Column, now: Column, pending_sec: int = 60) -> Column:
    """Pending for longer than ``pending_sec``, or in work with a lease that is over. Times in microseconds."""
    waiting = (status == "pending") & (now - created > pending_sec * SECOND)
    return F.coalesce(waiting | (status.startswith("processing") & (now > lease)), F.lit(False))
