"""Readers: transcripts, captions, word lists, progress logs. Each gives a DataFrame with declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.values import clock_seconds, finite, first_present

SEGMENTS = "start double, end double, text string"
WORD = "struct<text: string, start: double, end: double, type: string, speaker_id: string, channel_index: int>"
SPEECH = f"words array<{WORD}>, transcripts array<struct<channel_index: int, words: array<{WORD}>>>"
AUDIO = "source string, duration_sec double, events array<struct<label: string, start: double, end: double>>"
# The prefix and the field names of progress lines.
PROGRESS_PREFIX = "[ocr-events-progress]"
PROGRESS_NUMBERS = ["percent", "sampled", "total_samples", "observations", "scene_cuts", "ocr_calls", "roi_candidates", "samples_per_sec", "frames_per_sec", "video_speed_x"]
PROGRESS_OPTIONAL = ["video_time_sec", "video_duration_sec", "elapsed_sec", "eta_sec"]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse_srt(files: DataFrame, content: str = "content") -> DataFrame:
    """Subtitle blocks as rows: the other columns of files, block (from 1), start, end, text. Blocks of fewer than 3 lines or without times or text are dropped."""
    rest = [c for c in files.columns if c != content]
    blocks = files.select(*rest, F.posexplode(F.split(F.trim(F.col(content)), r"\r?\n\r?\n+")).alias("block", "_text"))
    lines = F.filter(F.split("_text", r"\r?\n"), lambda x: x != "")
    rows = blocks.select(*rest, (F.col("block") + 1).alias("block"), lines.alias("_lines")).where(F.size("_lines") >= 3)
    times = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})\s+-->\s+(\d{2}):(\d{2}):(\d{2}),(\d{3})"
    line = F.element_at("_lines", 2)
    part = lambda k: F.regexp_extract(line, times, k).cast("double")
    second = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    text = F.trim(F.array_join(F.slice("_lines", 3, F.size("_lines")), " "))
    return rows.where(line.rlike(times)).select(*rest, "block", second(1).alias("start"), second(5).alias("end"), text.alias("text")).where("text <> ''")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark reads it from."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_transcript(spark: SparkSession, json_path: str | None, srt_path: str | None = None) -> DataFrame:
    """Segments of a JSON array, or of subtitles where there is no such file (or the path is None)."""
    if json_path is not None and path_exists(spark, json_path):
        return spark.read.schema(SEGMENTS).json(json_path, multiLine=True)
    return parse_srt(whole_files(spark, srt_path)).select("start", "end", "text")


def parse_captions(lines: DataFrame, keys: list[str], last: float = 5.0) -> DataFrame:
    """keys, n, start, end, text of caption lines ``**H:MM:SS** · text`` (columns keys, n, line); end is the next start."""
    from weftline.operators.islands import end_from_next

    shape = r"^\*\*([\d:]+)\*\*\s*·\s*(.*)$"
    line = F.trim(F.regexp_replace("line", r"\r$", ""))
    rows = lines.where(line.rlike(shape)).select(*keys, "n", clock_seconds(F.regexp_extract(line, shape, 1)).alias("start"), F.regexp_extract(line, shape, 2).alias("text"))
    return end_from_next(rows, keys, last, "n").select(*keys, "n", "start", "end", "text")


def music_captions(captions: DataFrame) -> DataFrame:
    """The captions that say [música] or [music], escaped or not."""
    return captions.where(F.col("text").rlike(r"(?iu)\[m[uú]sica\]|\[music\]|\\\[m[uú]sica\\\]"))


def flatten_words(responses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, start, end, type, speaker_id, channel_index of speech responses (columns words, transcripts).

    Words of the channels if there are any channels, else the words of the response itself.
    """
    inherited = lambda t: F.transform(t["words"], lambda w: w.withField("channel_index", F.coalesce(w["channel_index"], t["channel_index"])))
    channels = F.flatten(F.transform("transcripts", lambda t: F.coalesce(inherited(t), F.array().cast(f"array<{WORD}>"))))
    found = F.when(F.coalesce(F.size("transcripts"), F.lit(0)) > 0, channels).otherwise(F.col("words"))
    return responses.select(*keys, F.explode(found).alias("w")).select(*keys, "w.*").where("text is not null and text <> ''")


def parse_audio_events(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys, source, duration, label, start, end of sound events in JSON documents: rows with finite times, labels in lower case; duration is the header's or the last end."""
    doc = F.from_json(json, AUDIO)
    good = F.filter(doc["events"], lambda e: e.isNotNull() & finite(e["start"]) & finite(e["end"]))
    last = F.array_max(F.transform("_events", lambda e: e["end"]))
    parsed = rows.select(*keys, doc["source"].alias("source"), doc["duration_sec"].alias("_length"), good.alias("_events")).withColumn("duration", F.coalesce("_length", last))
    return parsed.select(*keys, "source", "duration", F.explode("_events").alias("e")).select(*keys, "source", "duration", F.lower("e.label").alias("label"), "e.start", "e.end")


def read_audio_events(spark: SparkSession, path: str) -> DataFrame:
    """source, duration, label, start, end of files of sound events."""
    return parse_audio_events(whole_files(spark, path), ["path"], "content").drop("path")


def parse_progress(lines: DataFrame, line: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and progress events of log lines: the JSON after the prefix. Lines with a missing or wrong field are dropped. Works on streams."""
    at = F.expr(f"locate('{PROGRESS_PREFIX}', {line})")
    body = F.trim(F.expr(f"substring({line}, locate('{PROGRESS_PREFIX}', {line}) + {len(PROGRESS_PREFIX)})"))
    schema = "type string, targeted boolean, " + ", ".join(f"{n} double" for n in PROGRESS_NUMBERS + PROGRESS_OPTIONAL)
    parsed = lines.where(at > 0).select(*keys, body.alias("_body")).where(F.col("_body").startswith("{")).select(*keys, F.from_json("_body", schema, {"mode": "PERMISSIVE"}).alias("e")).select(*keys, "e.*")
    complete = (F.col("type") == "ocr_progress") & F.col("targeted").isNotNull()
    for n in PROGRESS_NUMBERS:
        complete = complete & finite(F.col(n))
    return parsed.where(complete)


def bounds_of(json: Column) -> tuple[Column, Column]:
    """Start and end of a document under the first of several layouts that has them."""
    start = first_present(json, "$.clip_start_sec", "$.sermon_start_sec", "$.boundaries.start", "$.start").try_cast("double")
    end = first_present(json, "$.clip_end_sec", "$.sermon_end_sec", "$.boundaries.end", "$.end").try_cast("double")
    return start, end


#: Names of a turn's fields, the first that is set counts.
TURN_START = ["start", "start_sec", "from", "begin", "start_time"]
TURN_END = ["end", "end_sec", "to", "finish", "end_time"]
TURN_TEXT = ["text", "transcript"]


def _children(node: Column) -> Column:
    """The values in an object or array, none in anything else."""
    in_object = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
    return F.coalesce(in_object, F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def _field(node: Column, names: list[str], kind: str) -> Column:
    """The first of the fields that is there and not null."""
    return F.coalesce(*[F.try_variant_get(node, f"$.{n}", kind) for n in names])


def walk_turns(documents: DataFrame, keys: list[str], json: str, depth: int = 12) -> DataFrame:
    """keys, start, end, text of every object at any depth of a JSON document that has a start, a later end and a text.

    Start and end are finite numbers, or texts of such; the text is trimmed and not empty. Levels down to ``depth`` are opened
    as VARIANT values by column functions; only documents that are deeper, or that Spark can't parse (such as those
    with a field twice), go through Python, whole. What no one can parse has no turns, nor has a null.
    """
    parsed = documents.select(*keys, F.col(json).alias("_json"), F.try_parse_json(json).alias("_root"))
    top = F.when(F.col("_root").isNull(), F.array().cast("array<variant>")).otherwise(F.array("_root"))
    below = lambda levels, _: F.array_append(levels, F.flatten(F.transform(F.element_at(levels, -1), _children)))
    leveled = parsed.withColumn("_levels", F.aggregate(F.sequence(F.lit(0), F.lit(depth)), F.array(top), below))
    hard = (F.col("_root").isNull() & F.col("_json").isNotNull()) | F.exists(F.element_at("_levels", -1), lambda v: F.size(_children(v)) > 0)
    number = lambda v, names: _field(v, names, "string").try_cast("double")  # noqa: E731  a truth value is no number as a text
    objects = F.filter(F.flatten("_levels"), lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    spans = F.transform(objects, lambda v: F.struct(number(v, TURN_START).alias("start"), number(v, TURN_END).alias("end"), v.alias("node")))
    timed = leveled.where(~hard).select(*keys, F.explode(spans).alias("_turn")).select(*keys, "_turn.*").where(finite(F.col("start")) & finite(F.col("end")) & (F.col("end") > F.col("start")))
    said = F.filter(F.array(*[F.try_variant_get("node", f"$.{n}", "variant") for n in TURN_TEXT]), lambda v: v.isNotNull() & ~F.is_variant_null(v))
    texts = F.transform(said, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    found = timed.select(*keys, "start", "end", F.regexp_replace(F.get(texts, 0), r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    types = dict(documents.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), SEGMENTS])
    return found.unionByName(leveled.where(hard).select(*keys, "_json").mapInPandas(_walk_in_python(keys), schema))


def _walk_in_python(keys: list[str]):
    """The same for documents that column functions don't reach."""
    import json as decoder
    import math
    from collections import deque

    import pandas as pd

    def number(x) -> float:
        if isinstance(x, bool) or not isinstance(x, (int, float, str)):
            return math.nan
        try:
            return float(x)
        except ValueError:
            return math.nan

    def rows(batches):
        for frame in batches:
            out = []
            for *own, text in frame.itertuples(index=False):
                try:
                    todo = deque([decoder.loads(text)])
                except (ValueError, RecursionError):
                    todo = deque()
                while todo:
                    node = todo.popleft()
                    if isinstance(node, dict):
                        a, b, t = (next((node[n] for n in names if node.get(n) is not None), None) for names in (TURN_START, TURN_END, TURN_TEXT))
                        a, b, t = number(a), number(b), t.strip() if isinstance(t, str) else ""
                        if math.isfinite(a) and math.isfinite(b) and b > a and t:
                            out.append((*own, a, b, t))
                        todo += node.values()
                    elif isinstance(node, list):
                        todo += node
            yield pd.DataFrame(out, columns=[*keys, "start", "end", "text"])

    return rows


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, fingerprint of files: name, size and second of the last change, as ``name:size:seconds``. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.concat_ws(":", name, F.col("length").cast("string"), F.floor(F.col("modificationTime").cast("double")).cast("string")).alias("fingerprint"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def normalize_timeline(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with finite start and end, the text clean."""
    from weftline.functions.text import clean

    return df.where(finite(F.col("start")) & finite(F.col("end"))).withColumn(text, clean(F.col(text)))
