"""Sections and clips of a recording: checks of proposed rows, what texts and sounds around them say, cuts and titles.

Sections have keys, start, end, title, type, confidence; segments (texts in time) keys, start, end, text and a unique id.
Times are seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.values import clamp, finite
from weftline.operators.intervals import around, interval_join, label_seconds, locate, touches
from weftline.operators.nearest import as_of, nearest
from weftline.operators.selection import spaced

# Section types, older names of them, words in titles, and patterns of cues with their weights.
SECTION_TYPES = [
    "pre_service", "welcome", "announcement", "call_to_worship", "opening_prayer", "congregational_music", "scripture_reading", "child_presentation", "children_segment",
    "testimony", "offering", "prayer", "sermon", "ordinance_or_rite", "post_sermon_response", "closing", "post_service", "other",
]
OLD_TYPES = {
    "song": "congregational_music", "prayer": "prayer", "announcements": "announcement", "transition": "other",
    "child_segment": "child_presentation", "child_presentation": "child_presentation", "children_segment": "child_presentation",
}
ALTAR_WORDS = ["altar", "llamado", "invitación", "invitacion", "response", "respuesta", "appeal", "decision"]
PRAYER_WORDS = ["prayer", "oración", "oracion", "benediction", "bendición", "bendicion"]
MUSIC_WORDS = ["song", "canto", "alabanza", "worship"]
OFFERING_WORDS = ["altar", "response", "llamado"]
START_WORDS = ["sermon introduction", "sermon transition", "sermón"]
END_WORDS = ["sermón", "benediction", "bendición", "bendicion"]
START_KEYWORDS = ["predicación", "mensaje", "abramos la palabra", "lectura de hoy", "bíblica", "sermón"]
END_KEYWORDS = ["oremos", "vamos a orar", "despedida", "anuncios", "bendición", "amén"]
CUES = {
    "sermon": [r"\bfeliz s[áa]bado\b", r"\b(predicaci[oó]n|serm[oó]n|mensaje)\b", r"\b(tema|t[ií]tulo)\b", r"\b(abr(a|an|amos)\s+(su|sus)?\s*biblias?|abra su biblia)\b", r"\b(palabra de dios|evangelio|texto b[ií]blico|pasaje)\b", r"\b(vamos a estudiar|estudiemos)\b"],
    "prayer": [r"\b(oremos|oraci[oó]n|orar|inclinar el rostro|inclinen el rostro|pong[aá]monos de rodillas)\b", r"\b(te lo pedimos|en el nombre de jes[uú]s|am[eé]n[,.\s]|am[eé]n$)\b", r"\b(padre nuestro|se[ñn]or te damos gracias)\b"],
    "worship": [r"\b(cantemos|vamos a cantar|alabanza|adoraci[oó]n|himno|canci[oó]n|m[uú]sica)\b", r"\b(grupo de alabanza|equipo de alabanza|coro)\b"],
    "announcement": [r"\b(anuncios|anuncio|recordatorio|actividad|programaci[oó]n)\b", r"\b(diezmos?|ofrendas?|ofertorio|potluck|convivio)\b", r"\b(abrazo al que est[aá] al lado|saluda al que est[aá] a tu lado)\b"],
    "closing": [r"\b(am[eé]n[,.\s]|am[eé]n$)\b", r"\b(oraci[oó]n final|oramos|oremos)\b", r"\b(bendici[oó]n|despedida|que dios les bendiga)\b"],
    "handoff": [r"\b(vamos a cantar|cantemos|alabanza)\b", r"\b(invito al (equipo|grupo) de alabanza)\b", r"\b(p[óo]nganse de pie|ponerse de pie|pasen aqu[ií]|pasar aqu[ií])\b", r"\b(les queremos agradecer|gracias pastor)\b"],
}
CUE_WEIGHTS = {"sermon": (1.0, 0.4), "prayer": (0.95, 0.6), "worship": (1.0, 0.6), "announcement": (1.0, 0.5), "closing": (1.0, 0.4), "handoff": (1.0, 0.5)}
HANDOFF_NEAR = [r"\b(vamos a cantar|cantemos|alabanza)\b", r"\b(invito al (equipo|grupo) de alabanza)\b", r"\b(pasen (aquí|adelante)|ponerse de pie)\b", r"\b(terminamos cantando|oración final)\b", r"\b(les queremos agradecer|gracias pastor)\b"]
GREETING = r"\bfeliz s[áa]bado\b"
START_CUES = [(2.4, r"\bfeliz s[áa]bado\b"), (2.0, r"\b(abr(a|an|amos)\s+(su|sus)?\s*biblias?|abra su biblia)\b"), (1.8, r"\b(predicaci[oó]n|serm[oó]n|mensaje)\b"), (1.2, r"\b(tema|t[ií]tulo)\b"), (1.2, r"\b(vamos a estudiar|estudiemos|palabra de dios)\b")]
START_REJECTS = [(-1.4, r"\b(cantemos|vamos a cantar|alabanza|adoraci[oó]n|himno)\b"), (-1.4, r"\b(ofrendas?|diezmos?|anuncios?)\b")]
END_CUES = [(1.3, r"\b(am[eé]n[,.\s]|am[eé]n$)\b"), (1.6, r"\b(oraci[oó]n final|oremos|oramos)\b"), (1.4, r"\b(vamos a cantar|cantemos|equipo de alabanza)\b"), (1.4, r"\b(les queremos agradecer|gracias pastor|que dios les bendiga)\b"), (1.0, r"\b(ponerse de pie|p[óo]nganse de pie)\b")]
INTRO_CUE = r"est[aá]s listo para el mensaje|hoy que vamos a estudiar la palabra|quiero comenzar dici[eé]ndote|abran? sus biblias|mensaje de hoy|tema de hoy"
PRE_INTRO_CUE = r"est[aá]s listo para el mensaje|hoy que vamos a estudiar la palabra|quiero comenzar dici[eé]ndote"
NOTICE_CUE = r"anuncios?|announcement|actividades|recuerden|les invitamos|esta tarde|despu[eé]s del culto|hoy tenemos|compartir con ustedes|les queremos agradecer"
MIXED_TITLE = r"announcements?\s*&\s*sermon\s*(introduction|transition)|(anuncios?|announcement).*(serm[oó]n|sermon)|(serm[oó]n|sermon).*(anuncios?|announcement)"
SPEAKER_CUE = r"\b(pr\.?|pastor|anciano|hno\.?|hna\.?|elder)\b"
#: A word boundary between ASCII letters, digits and _ and anything else.
_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_borders(pattern: str) -> str:
    return pattern.replace(r"\b", _BORDER)


def hits(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(ascii_borders(rx))) for rx in patterns), F.lit(0))


def says(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for rx in patterns:
        out = out | text.rlike(ascii_borders(rx))
    return out


#: Stems of the words that CUES, GREETING and HANDOFF_NEAR are made of, and the small words between and before them.
_CUE_STEMS = (
    "abr|actividad|adelante|adoraci|agradecer|alabanza|am[eé]n|anuncio|aqu[ií]|b[ií]blic|biblia|bendi|canci|canta|cantemos|convivio|coro|damos|despedida|diezmo|dios|equipo|"
    "estudi|evangelio|feliz|final|gracias|grupo|himno|inclin|invito|jes[uú]s|lado|m[uú]sica|mensaje|nombre|nuestro|ofertorio|ofrenda|ora|oremos|padre|palabra|pasaje|pasar|"
    "pasen|pastor|pedimos|pie|p[oó]nganse|ponerse|pong[aá]monos|potluck|predicaci|programaci|queremos|recordatorio|rodillas|rostro|s[áa]bado|saluda|se[ñn]or|serm[oó]n|tema|"
    "terminamos|texto|t[ií]tulo|vamos"
)
_SMALL_WORDS = "a|al|de|el|en|est[aá]|les|lo|que|su|sus|te|tu"
_NO_CUE = rf"(?![^ ]*?(?:{_CUE_STEMS})|[^ ]*?(?<![A-Za-z0-9_])(?:{_SMALL_WORDS})(?![^ ]))"


def cue_words(text: Column) -> Column:
    """A clean, lower-case text in which each run of words of no cue is its first character and a sign that no cue has.

    The cues find in it, and in any texts joined from such, what they find in the whole: words of cues keep their places beside each other, and the
    character after them says as before whether a word begins there.
    """
    return F.regexp_replace(text, rf"(?<![^ ]){_NO_CUE}([^ ])[^ ]*+(?: {_NO_CUE}[^ ]++)*+", "$1¤")


def holds_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# --- checks of proposed rows ------------------------------------------------------------------------


def valid_sections(rows: DataFrame, duration: Column) -> DataFrame:
    """The rows (start, end, confidence as text; title, type, reason) that are sections: times inside the recording, known types, defaults."""
    start, end, sure = (F.col(c).try_cast("double") for c in ("start", "end", "confidence"))
    kind = F.lower(T.clean(F.coalesce("type", F.lit("other"))))
    for old, new in OLD_TYPES.items():
        kind = F.when(F.lower(T.clean(F.coalesce("type", F.lit("other")))) == old, F.lit(new)).otherwise(kind)
    out = rows.where(finite(start) & finite(end) & (end > start) & (T.clean(F.col("title")) != ""))
    return out.withColumns({
        "start": clamp(start, 0.0, duration), "end": clamp(end, 0.0, duration), "title": T.clean(F.col("title")), "reason": T.clean(F.col("reason")),
        "type": F.when(kind.isin(SECTION_TYPES), kind).otherwise(F.lit("other")), "confidence": F.when(finite(sure), clamp(sure, 0.0, 1.0)).otherwise(F.lit(0.6)),
    })


def valid_clips(rows: DataFrame, low: Column, high: Column, least: float, most: float) -> DataFrame:
    """The rows (start, end, title, excerpt, hook, hook_type, confidence, score, hook_strength, spiritual_impact, shareability) that are clips.

    Times are cut to the bounds and to ``most`` seconds; clips shorter than ``least`` are dropped. Without any of
    the three newer scores the older ``score`` (or the confidence) counts as the impact.
    """
    a = clamp(F.col("start"), low, high)
    b = clamp(F.col("end"), low, high)
    out = rows.where(finite(F.col("start")) & finite(F.col("end"))).withColumn("_a", a).withColumn("_b", F.least(b, F.col("_a") + most)).where((F.col("_b") > F.col("_a")) & (F.col("_b") - F.col("_a") >= least))
    new = finite(F.col("hook_strength")) | finite(F.col("spiritual_impact")) | finite(F.col("shareability"))
    part = lambda c, other: clamp(F.when(new, F.coalesce(c, F.lit(0.5))).otherwise(other), 0.0, 1.0)
    title = F.coalesce(F.nullif(T.clean(F.col("title")), F.lit("")), F.lit("Sermon Highlight"))
    out = out.withColumns({
        "start": F.round("_a", 2), "end": F.round("_b", 2), "hook_strength": part("hook_strength", F.lit(0.5)), "shareability": part("shareability", F.lit(0.5)),
        "spiritual_impact": part("spiritual_impact", F.coalesce("score", "confidence", F.lit(0.5))), "title": title, "excerpt": T.clean(F.col("excerpt")), "hook": T.clean(F.col("hook")), "hook_type": T.hook_type(F.col("hook_type")),
    })
    return out.withColumn("confidence", clamp(F.coalesce("confidence", F.lit(0.55)), 0.0, 1.0)).drop("_a", "_b", "score")


def valid_cues(cues: Column) -> Column:
    """At most 4 of an array of (offset_sec, at_seconds, keywords, description): those with an offset of 0 or more and keywords, of which 4 stay."""
    offset = lambda c: F.coalesce(c["offset_sec"], c["at_seconds"], F.lit(0.0))
    words = lambda c: F.slice(F.filter(F.transform(F.coalesce(c["keywords"], F.array().cast("array<string>")), T.clean), lambda x: x != ""), 1, 4)
    good = F.filter(cues, lambda c: c.isNotNull() & finite(offset(c)) & (offset(c) >= 0) & (F.size(words(c)) > 0))
    made = F.transform(good, lambda c: F.struct(F.round(offset(c), 2).alias("offset_sec"), words(c).alias("keywords"), F.substring(T.clean(c["description"]), 1, 120).alias("description")))
    return F.slice(made, 1, 4)


def renormalized_clips(rows: DataFrame, last: Column) -> DataFrame:
    """Clips once more: start at 0 or more, at least a second long, within the last end; the score is the confidence where there is none."""
    start = F.greatest(F.lit(0.0), F.col("start"))
    end = F.greatest(start + 1, F.least(F.col("end"), F.when(last > 0, last).otherwise(F.col("end"))))
    out = rows.where(finite(F.col("start")) & finite(F.col("end"))).withColumn("_start", start).withColumn("end", end).withColumn("start", F.col("_start"))
    sure = F.when(finite(F.col("confidence")), clamp(F.col("confidence"), 0.0, 1.0)).otherwise(F.lit(0.5))
    score = F.when(finite(F.col("score")), clamp(F.col("score"), 0.0, 1.0)).otherwise(sure)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Sermon Highlight"))
    return out.withColumns({"title": title, "confidence": sure, "score": score}).drop("_start")


def section_classes(kind: Column, title: Column) -> dict[str, Column]:
    """Whether a section is like a call to the altar, a prayer, music as a response, by type or words in the title."""
    t, name = F.lower(T.clean(kind)), F.lower(T.clean(title))
    return {
        "altar": t.isin("altar_call", "post_sermon_response") | holds_any(name, ALTAR_WORDS),
        "prayer": t.isin("prayer", "closing", "benediction") | holds_any(name, PRAYER_WORDS),
        "music": t.isin("congregational_music", "special_music") | ((t == "offering") & holds_any(name, OFFERING_WORDS)) | holds_any(name, MUSIC_WORDS),
    }


def shifted(turns: DataFrame, offset: Column, prefix: Column) -> DataFrame:
    """Turns of a part of a recording at their place in the whole; speakers get the prefix, if it isn't null."""
    named = F.when(prefix.isNotNull(), F.concat(prefix, F.lit(":"), F.col("speaker"))).otherwise(F.col("speaker"))
    return turns.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset, "speaker": named})


def chosen_for_package(events: DataFrame, keys: list[str], take_all: Column) -> DataFrame:
    """All events of a key, or the flagged ones (extract), or else the representatives, or else all of them."""
    w = W.partitionBy(*keys)
    any_of = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).over(w) == 1
    marked = events.withColumn("_extract", any_of("extract")).withColumn("_rep", any_of("representative"))
    keep = F.when(take_all, F.lit(True)).when(F.col("_extract"), F.coalesce("extract", F.lit(False))).when(F.col("_rep"), F.coalesce("representative", F.lit(False))).otherwise(F.lit(True))
    return marked.where(keep).drop("_extract", "_rep")


def lasting_text(kind: Column, start: Column, end: Column, sample: float) -> Column:
    """Whether an on-screen text is more than a flash of no special type."""
    return (kind != "on_screen_text") | (end - start >= max(2.0, sample * 1.5))


def title_candidate(text: Column, kind: Column, lane: Column) -> Column:
    t = T.clean(text)
    slide = (F.lower(F.coalesce(lane, F.lit(""))) == "slides") & t.rlike("(?iu)" + ascii_borders(r"\b(tema|t[íi]tulo|mensaje|serm[óo]n|predicaci[óo]n)\b"))
    return (t != "") & ((F.lower(F.coalesce(kind, F.lit(""))) == "sermon_title") | slide)


def sure_speaker(text: Column, kind: Column, confidence: Column, least: float) -> Column:
    return (F.lower(F.coalesce(kind, F.lit(""))) == "speaker_name") & (F.coalesce(confidence, F.lit(0.0)) >= least) & (F.length(T.clean(text)) >= 3)


def window_hint(start: Column, end: Column, found_start: Column, found_end: Column) -> Column:
    """Struct (start, end): the explicit bounds if the start is above 0, else the discovered ones; an end before the start is none."""
    given = F.coalesce(start > 0, F.lit(False))
    a = F.when(given, start).otherwise(F.greatest(F.lit(0.0), found_start))
    b = F.when(given, F.when(end > start, end)).otherwise(F.when(found_end > found_start, F.greatest(found_start, found_end)))
    return F.struct(F.when(given | found_start.isNotNull(), a).alias("start"), F.when(given | found_start.isNotNull(), b).alias("end"))


# --- documents about a recording --------------------------------------------------------------------

CONTEXT = "paragraphs array<struct<start: double, end: double, chapter_index: int, chapter_title: string, text: string>>, chapters array<struct<start: double, end: double, title: string, type: string, confidence: double>>"


def polished_context(rows: DataFrame, keys: list[str], json: str, low: Column, high: Column, part: str) -> DataFrame:
    """keys and the fields of the ``paragraphs`` or ``chapters`` (part) of a JSON document that touch the bounds."""
    parsed = rows.select(*keys, low.alias("_low"), high.alias("_high"), F.explode(F.from_json(json, CONTEXT)[part]).alias("p")).select(*keys, "_low", "_high", "p.*")
    return parsed.where(finite(F.col("start")) & finite(F.col("end")) & (F.col("end") >= F.col("_low")) & (F.col("start") <= F.col("_high"))).drop("_low", "_high")


def slide_events(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys, start, end, type, text of the events of a JSON document; an absent type is on_screen_text."""
    schema = "events array<struct<start: double, end: double, type: string, text: string>>"
    found = rows.select(*keys, F.explode(F.from_json(json, schema)["events"]).alias("e")).select(*keys, "e.*")
    kind = F.coalesce(F.nullif(T.clean(F.col("type")), F.lit("")), F.lit("on_screen_text"))
    return found.withColumn("type", kind)


# --- signals ----------------------------------------------------------------------------------------


def gathered(frames: DataFrame, segments: DataFrame, keys: list[str], frame: list[str], width: float) -> DataFrame:
    """keys, frame and text: the words of cues in the lower-case texts of the segments that touch each frame (start, end), in order (``cue_words``: a long text
    goes to many frames, few of its words matter); frames without any are absent."""
    right = segments.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("_rid"), cue_words(F.lower(T.clean(F.col("text")))).alias("_text"))
    pairs = interval_join(frames, right, keys, width, touches)
    packed = F.array_sort(F.collect_list(F.struct("r_start", "r_end", "_rid", "_text")))
    return pairs.groupBy(*keys, *frame).agg(F.array_join(F.transform(packed, lambda x: x["_text"]), " ").alias("text"))


def text_signal(points: DataFrame, segments: DataFrame, keys: list[str], at_start: bool, width: float = 60.0) -> DataFrame:
    """points (keys, id, t) with cue scores of the speech before and after, and what follows from them."""
    before, after = (180.0, 210.0) if at_start else (160.0, 170.0)
    t, zero = F.col("t"), F.lit(0.0)
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.alias("start"), b.alias("end"))
    early = F.greatest(zero, t - 8)
    frames = points.select(*keys, F.col("id"), "t", F.explode(F.array(side("before", F.greatest(zero, t - before), early), side("after", early, t + after), side("near", F.greatest(zero, t - 95), t + 95))).alias("_f"))
    frames = frames.select(*keys, F.col("id").alias("pid"), "_f.*")
    speech = gathered(frames.where("side <> 'near'"), segments.where(~T.non_speech(F.col("text"))), keys, ["pid", "side"], width)
    near = gathered(frames.where("side = 'near'"), segments, keys, ["pid", "side"], width)
    texts = speech.unionByName(near).groupBy(*keys, F.col("pid").alias("id")).agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("text"))), F.lit("")).alias(f"_{s}") for s in ("before", "after", "near")))
    out = points.join(texts, [*keys, "id"], "left").fillna("", ["_before", "_after", "_near"])
    for name, patterns in CUES.items():
        a, b = CUE_WEIGHTS[name]
        out = out.withColumn(name, F.round(hits(F.col("_after"), patterns) * a + hits(F.col("_before"), patterns) * b, 6))
    c = F.col
    out = out.withColumn("greeting", says(c("_after"), [GREETING]))
    weak = c("sermon") < 1.2
    out = out.withColumns({"prayer_dominant": (c("prayer") >= 2.2) & weak, "worship_dominant": (c("worship") >= 1.9) & weak, "announcement_dominant": (c("announcement") >= 1.7) & weak})
    likely = (F.round(c("sermon") + F.when(c("greeting"), 1.2).otherwise(0.0), 6) >= 1.8) & ~(c("prayer_dominant") | c("worship_dominant") | c("announcement_dominant"))
    return out.withColumns({
        "sermon_likely": likely, "closing_likely": (c("closing") >= 1.3) | ((c("closing") >= 0.8) & (c("handoff") >= 0.8)), "handoff_likely": (c("handoff") >= 1.0) | says(c("_near"), HANDOFF_NEAR),
    }).drop("_before", "_after", "_near")


def cue_candidates(segments: DataFrame, guesses: DataFrame, keys: list[str], at_start: bool, most: int = 8) -> DataFrame:
    """keys, t: the starts (or ends) of segments with the best cues near the guess (keys, guess_start, guess_end), 15 seconds apart.

    Score: weights of the cues, less those of songs and notices for starts, and up to a point for being near the guess.
    """
    t = F.col("start") if at_start else F.col("end")
    a, b = F.col("guess_start"), F.col("guess_end")
    if at_start:
        low = F.greatest(F.lit(0.0), a - 420)
        high, cues, least, guess = F.greatest(low + 30, F.least(b - 30, a + 1800)), START_CUES + START_REJECTS, 1.2, a
    else:
        low, high, cues, least, guess = F.greatest(a + 60, b - 1600), b + 500, END_CUES, 1.0, b
    text = F.lower(T.clean(F.col("text")))
    score = sum((F.when(text.rlike(ascii_borders(rx)), F.lit(w)).otherwise(F.lit(0.0)) for w, rx in cues), F.lit(0.0)) + F.greatest(F.lit(0.0), 1 - F.abs(t - guess) / 900)
    rows = segments.join(guesses, keys).where(t.between(low, high) & ~T.non_speech(F.col("text")))
    scored = rows.select(*keys, t.alias("t"), (-F.round(score, 6)).alias("_order")).where(F.col("_order") <= -least)
    return spaced(scored, keys, "t", ["_order", "t"], 15.0, most).select(*keys, F.explode("kept").alias("t"))


def type_signal(points: DataFrame, events: DataFrame, keys: list[str], frame: float, width: float) -> DataFrame:
    """points (keys, id, t) with the shares of on-screen types before and after: titles and verses together, lyrics, names; and what follows.

    events have keys, type, text, r_start, r_end. A text that names a speaker counts for speaker_text, with a phrase or seven words for speaker_phrase.
    """
    frames = around(points, frame).withColumn("window", F.struct("id", "side"))
    text = T.clean(F.col("text"))
    named = text.rlike("(?iu)" + ascii_borders(SPEAKER_CUE))
    phrase = named & (text.rlike("(?iu)" + ascii_borders(SPEAKER_CUE) + "." + "*(:|[\"“”'])") | (F.size(T.words(text)) >= 7))
    kinds = F.array_compact(F.array(F.lower(F.coalesce("type", F.lit("on_screen_text"))), F.when(named, "speaker_text"), F.when(phrase, "speaker_phrase")))
    labelled = events.select(*keys, "r_start", "r_end", F.explode(kinds).alias("label"))
    found = label_seconds(frames.select(*keys, "window", "start", "end"), labelled, keys, width)
    length = F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    shares = frames.select(*keys, "window", length.alias("_len")).join(found, [*keys, "window"], "left")
    groups = {"cue": ["sermon_title", "bible_verse"], "lyric": ["song_lyric"], "name": ["speaker_name"], "speaker": ["speaker_text"], "phrase": ["speaker_phrase"]}
    part = lambda side, names: F.coalesce(F.sum(F.when((F.col("window.side") == side) & F.col("label").isin(names), F.col("length") / F.col("_len"))), F.lit(0.0))
    aggs = [F.round(part(side, names), 6).alias(f"{side}_{n}") for side in ("before", "after") for n, names in groups.items()]
    out = points.join(shares.groupBy(*keys, F.col("window.id").alias("id")).agg(*aggs), [*keys, "id"])
    c = F.col
    near = lambda n, least: (c(f"before_{n}") >= least) | (c(f"after_{n}") >= least)
    return out.withColumns({
        "lyric_to_sermon": (c("before_lyric") >= 0.12) & (c("after_cue") >= 0.08), "sermon_to_lyric": (c("before_cue") >= 0.08) & (c("after_lyric") >= 0.12),
        "lyric_dominant": (c("before_lyric") + c("after_lyric")) / 2 >= 0.2, "cue_near": near("cue", 0.08), "name_near": near("name", 0.08) | near("speaker", 0.08), "phrase_near": near("phrase", 0.1),
    })


def section_signals(sections: DataFrame, events: DataFrame, keys: list[str], width: float) -> DataFrame:
    """sections (keys, id, start, end) with the shares of speech, music and pause in them (3 decimals) and two flags; events have label, r_start, r_end."""
    found = label_seconds(sections.select(*keys, F.col("id").alias("window"), "start", "end"), events, keys, width)
    sums = lambda *names: F.coalesce(F.sum(F.when(F.col("label").isin(*names), F.col("length"))), F.lit(0.0))
    wide = found.groupBy(*keys, F.col("window").alias("id")).agg(sums(*T.SPEECH_LABELS).alias("_speech"), sums("music").alias("_music"), sums("noenergy").alias("_pause"))
    out = sections.join(wide, [*keys, "id"], "left").fillna(0.0, ["_speech", "_music", "_pause"])
    share = lambda c: F.col(c) / F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    out = out.withColumns({"speech_ratio": F.round(share("_speech"), 3), "music_ratio": F.round(share("_music"), 3), "pause_ratio": F.round(share("_pause"), 3)})
    return out.withColumns({"has_music": share("_music") >= 0.2, "has_long_pause": share("_pause") >= 0.08}).drop("_speech", "_music", "_pause")


def sermon_hint(sections: DataFrame, segments: DataFrame, keys: list[str], scan: float = 240.0, width: float = 120.0) -> DataFrame:
    """keys, start, end, confidence: the earliest section that begins a sermon, the last end of one that closes it, and their mean confidence.

    A beginning whose first ``scan`` seconds are more song and prayer than sermon counts only if there is no other.
    """
    kind, title = F.lower(T.clean(F.col("type"))), F.lower(T.clean(F.col("title")))
    good = sections.where(finite(F.col("start")) & finite(F.col("end")) & (F.col("end") > F.col("start")))
    begins = (kind == "sermon") | holds_any(title, START_WORDS)
    ends = kind.isin("sermon", "post_sermon_response", "closing", "benediction") | holds_any(title, END_WORDS)
    marked = good.withColumn("_begins", begins).withColumn("_ends", ends)
    heads = marked.where("_begins").select(*keys, F.col("id").alias("sid"), "start", F.least("end", F.col("start") + scan).alias("end"))
    right = segments.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), T.clean(F.col("text")).alias("_t"))
    pairs = interval_join(heads, right, keys, width, touches)
    count = lambda rx: F.count_if(F.col("_t").rlike(T.anywhere(rx)))
    seen = pairs.groupBy(*keys, "sid").agg(count(T.KICKOFF_TEXT).alias("k"), count(T.PRAYER_TEXT).alias("p"), count(T.WORSHIP_TEXT).alias("w"), count(T.CALL_TO_WORSHIP).alias("c"))
    liturgy = seen.select(*keys, F.col("sid").alias("id"), ((F.col("c") > 0) | (F.col("p") + F.col("w") > F.col("k") + 2)).alias("_liturgy"))
    rows = marked.join(liturgy, [*keys, "id"], "left").withColumn("_clean", F.col("_begins") & ~F.coalesce("_liturgy", F.lit(False)))
    rows = rows.withColumn("_any", F.max(F.col("_clean").cast("int")).over(W.partitionBy(*keys)) == 1)
    pool = F.when(F.col("_any"), F.col("_clean")).otherwise(F.col("_begins"))
    sure = F.coalesce("confidence", F.lit(0.75))
    total = F.sum(F.when(pool, sure).otherwise(0.0) + F.when(F.col("_ends"), sure).otherwise(0.0)) / F.sum(pool.cast("int") + F.col("_ends").cast("int"))
    out = rows.groupBy(*keys).agg(F.min(F.when(pool, F.col("start"))).alias("start"), F.max(F.when(F.col("_ends"), F.col("end"))).alias("end"), total.alias("confidence"))
    return out.where("start is not null and end is not null").withColumn("confidence", F.round(clamp(F.col("confidence"), 0.0, 1.0), 6))


def keyword_bounds(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: from the first text with a word of beginnings to the last with a word of endings; the whole recording if that is nothing."""
    text = F.lower("text")
    order = F.struct("start", "end", "id")
    first = F.min_by("start", F.when(holds_any(text, START_KEYWORDS), order))
    last = F.max_by("end", F.when(holds_any(text, END_KEYWORDS), order))
    out = segments.groupBy(*keys).agg(first.alias("_a"), last.alias("_b"), F.max_by("end", order).alias("_end"))
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", "_end")
    return out.select(*keys, F.when(a >= b, F.lit(0.0)).otherwise(a).alias("start"), F.when(a >= b, F.col("_end")).otherwise(b).alias("end"))


# --- cuts and titles --------------------------------------------------------------------------------


def first_cues(sections: DataFrame, segments: DataFrame, keys: list[str], pattern: str, width: float, before: str | None = None) -> DataFrame:
    """sections with ``cut``, the start of the first text in them that has the cue, and ``noted``, whether a text before it has the cue ``before``."""
    right = segments.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("_rid"), T.clean(F.col("text")).alias("_t"))
    pairs = interval_join(sections.select(*keys, F.col("id").alias("sid"), "start", "end"), right, keys, width, touches)
    place = F.struct("r_start", "_rid")
    aggs = [F.min(F.when(F.col("_t").rlike(T.anywhere(pattern)), place)).alias("_cut")]
    aggs.append(F.min(F.when(F.col("_t").rlike(T.anywhere(before)), place)).alias("_note") if before else F.lit(None).cast("struct<r_start: double, _rid: bigint>").alias("_note"))
    found = pairs.groupBy(*keys, "sid").agg(*aggs).select(*keys, F.col("sid").alias("id"), F.col("_cut.r_start").alias("cut"), F.coalesce(F.col("_note") < F.col("_cut"), F.lit(False)).alias("noted"))
    return sections.join(found, [*keys, "id"], "left").withColumn("noted", F.coalesce("noted", F.lit(False)))


def _parts(df: DataFrame, parts: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in ("start", "end", "title", "type", "confidence")]
    return df.select(*rest, F.explode(parts).alias("_p")).select(*rest, "_p.*")


def _part(start, end, title, kind, confidence) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), title.alias("title"), kind.alias("type"), confidence.alias("confidence"))


def split_notices_from_sermon(sections: DataFrame, segments: DataFrame, keys: list[str], width: float = 120.0, least: float = 10.0) -> DataFrame:
    """Sections that mix notices with the beginning of a sermon become two at its first cue, or a sermon if a part would be short."""
    df = first_cues(sections, segments, keys, INTRO_CUE, width, NOTICE_CUE)
    c, at = F.col, clamp(F.col("cut"), F.col("start"), F.col("end"))
    split = c("cut").isNotNull() & (c("title").rlike(T.anywhere(MIXED_TITLE)) | ((c("type") == "announcement") & c("noted")))
    fits = (at - c("start") >= least) & (c("end") - at >= least)
    intro, sermon = F.lit("Sermon Introduction"), F.lit("sermon")
    two = F.array(_part(c("start"), at, F.lit("Announcements"), F.lit("announcement"), F.round(F.greatest(F.lit(0.5), c("confidence") - 0.05), 2)), _part(at, c("end"), intro, sermon, c("confidence")))
    same = F.array(_part(c("start"), c("end"), c("title"), c("type"), c("confidence")))
    return _parts(df, F.when(~split, same).when(fits, two).otherwise(F.array(_part(c("start"), c("end"), intro, sermon, c("confidence"))))).drop("cut", "noted")


def split_before_sermon(sections: DataFrame, segments: DataFrame, keys: list[str], boundary: str, width: float = 120.0, least: float = 20.0, near: float = 2.0) -> DataFrame:
    """The section that ends at the sermon's start (column ``boundary``) gives its end from the first cue on to the sermon."""
    df = first_cues(sections, segments, keys, PRE_INTRO_CUE, width)
    c, at = F.col, clamp(F.col("cut"), F.col("start"), F.col("end"))
    here = (F.abs(c("end") - c(boundary)) <= near) & (c("start") < c(boundary)) & (c("type") != "sermon") & ~c("title").rlike("(?i)sermon introduction") & c("cut").isNotNull()
    fits = (at - c("start") >= least) & (c("end") - at >= least)
    whole = (at - c("start") < least) & (c("end") - at >= 120)
    intro = lambda a: _part(a, c("end"), F.lit("Sermon Introduction"), F.lit("sermon"), F.round(F.greatest(F.lit(0.75), c("confidence")), 2))
    same = F.array(_part(c("start"), c("end"), c("title"), c("type"), c("confidence")))
    two = F.array(_part(c("start"), at, c("title"), c("type"), c("confidence")), intro(at))
    return _parts(df, F.when(here & fits, two).when(here & whole, F.array(intro(c("start")))).otherwise(same)).drop("cut", "noted")


#: What begins a sermon, and what is prayer and song before it.
PRELUDE_INTRO = r"abran? (?:sus )?biblias|mensaje de hoy|tema de hoy|hoy quiero|quiero compartir|la biblia|vers[íi]culo|cap[íi]tulo"
PRELUDE_PRAYER = r"oremos|oraci[oó]n|inclinemos|inclinar.*rostro|arrodill|en el nombre de (?:tu hijo )?cristo jes[uú]s|te lo pedimos|am[eé]n"
PRELUDE_WORSHIP = r"vamos a cantar|cantemos|equipo de alabanza|alabemos|worship|himno|coro|reproclamamos|en lo alto est[aá]s"


def split_prelude(sections: DataFrame, segments: DataFrame, keys: list[str], width: float = 120.0) -> DataFrame:
    """Sermons that begin with song or prayer become two at the first text that begins the sermon.

    That is for sermons of 120 seconds and six texts or more, with 25 seconds before and 90 after the cut, two texts or more before it and
    a quarter of them (a text that is both counts twice) song or prayer.
    """
    c = F.col
    right = segments.select(*keys, c("start").alias("r_start"), c("end").alias("r_end"), T.clean(c("text")).alias("_t"))
    sermons = sections.where("type = 'sermon'").select(*keys, c("id").alias("sid"), "start", "end")
    pairs = interval_join(sermons, right, keys, width, touches)
    has = lambda rx: c("_t").rlike(T.anywhere(rx))
    one = W.partitionBy(*keys, "sid")
    first = F.min(F.when(has(PRELUDE_INTRO), c("r_start"))).over(one)
    marked = pairs.withColumn("_cut", first).withColumn("_at", clamp(c("_cut"), c("start"), c("end")))
    early = lambda what: F.count_if((c("r_start") < c("_at")) & what)
    found = marked.groupBy(*keys, c("sid").alias("id")).agg(F.max("_at").alias("_at"), F.count("*").alias("_n"), early(F.lit(True)).alias("_pre"), early(has(PRELUDE_PRAYER)).alias("_prayers"), early(has(PRELUDE_WORSHIP)).alias("_songs"))
    df = sections.join(found, [*keys, "id"], "left")
    fits = (c("_n") >= 6) & (c("end") - c("start") >= 120) & (c("_at") - c("start") >= 25) & (c("end") - c("_at") >= 90)
    liturgy = (c("_pre") >= 2) & (c("_prayers") + c("_songs") >= 1) & ((c("_prayers") + c("_songs")) / c("_pre") >= 0.25)
    song = c("_songs") > c("_prayers")
    title = F.when(song, "Alabanza congregacional").when(c("_songs") > 0, "Oración y transición de adoración").otherwise("Oración congregacional")
    prelude = _part(c("start"), c("_at"), title, F.when(song, "congregational_music").otherwise("prayer"), F.round(F.greatest(F.lit(0.72), c("confidence") - 0.08), 2))
    sermon = _part(c("_at"), c("end"), F.when(c("title").rlike("(?i)sermon"), c("title")).otherwise("Sermón principal"), F.lit("sermon"), c("confidence"))
    same = F.array(_part(c("start"), c("end"), c("title"), c("type"), c("confidence")))
    return _parts(df, F.when(F.coalesce(fits & liturgy, F.lit(False)), F.array(prelude, sermon)).otherwise(same)).drop("_at", "_n", "_pre", "_prayers", "_songs")


def split_at_greeting(sections: DataFrame, segments: DataFrame, keys: list[str], lead: float = 20.0, tail: float = 40.0, context: float = 90.0, width: float = 120.0) -> DataFrame:
    """Sections become two at a greeting in them (``lead`` after their start, ``tail`` before their end) if what is said before and after it differs in
    kind, or what is before is prayer, song, notices or offering. Only sections of two texts or more, 20 seconds longer than both margins."""
    c = F.col
    right = segments.select(*keys, c("start").alias("r_start"), c("end").alias("r_end"), c("id").alias("_rid"), T.clean(c("text")).alias("_t"))
    pairs = interval_join(sections.select(*keys, c("id").alias("sid"), "start", "end"), right, keys, width, touches)
    one = W.partitionBy(*keys, "sid")
    here = c("_t").rlike(T.anywhere(T.GREETING)) & (c("r_start") >= c("start") + lead) & (c("r_end") <= c("end") - tail)
    marked = pairs.withColumn("_cut", F.min(F.when(here, c("r_start"))).over(one)).withColumn("_n", F.count("*").over(one))
    said = lambda near: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("r_start", "_rid", "_t")))), lambda x: x["_t"]), " ")
    before = said((c("r_end") >= c("_cut") - context) & (c("r_start") < c("_cut")))
    after = said((c("r_start") <= c("_cut") + context) & (c("r_end") > c("_cut")))
    found = marked.where("_cut is not null and _n >= 2").groupBy(*keys, c("sid").alias("id")).agg(F.max("_cut").alias("_at"), before.alias("_before"), after.alias("_after"))
    df = sections.join(found, [*keys, "id"], "left").withColumns({"_first": T.section_type(c("_before"), c("type")), "_second": T.section_type(c("_after"), c("type"))})
    split = c("_at").isNotNull() & (c("end") - c("start") >= lead + tail + 20) & (c("end") - c("_at") >= tail)
    turn = (c("_first") != c("_second")) | c("_first").isin("prayer", "congregational_music", "announcement", "offering")
    first = F.when(c("_first") == c("_second"), c("type")).otherwise(c("_first"))
    parts = F.array(
        _part(c("start"), c("_at"), F.when(first == c("type"), c("title")).otherwise(T.title_of(first)), first, c("confidence")),
        _part(c("_at"), c("end"), F.when(c("_second") == c("type"), F.concat("title", F.lit(" (reinicio)"))).otherwise(T.title_of(c("_second"))), c("_second"), F.round(F.greatest(F.lit(0.72), c("confidence")), 2)),
    )
    same = F.array(_part(c("start"), c("end"), c("title"), c("type"), c("confidence")))
    return _parts(df, F.when(F.coalesce(split & turn, F.lit(False)), parts).otherwise(same)).drop("_at", "_before", "_after", "_first", "_second")


def titles_by_neighbours(sections: DataFrame, keys: list[str], least: float = 0.78) -> DataFrame:
    """Titles of sections with little confidence, from their type and those next to them; other titles stay."""
    order = W.partitionBy(*keys).orderBy("start", "id")
    before, after, kind = F.lag("type").over(order), F.lead("type").over(order), F.col("type")
    sermon = F.lit("sermon")
    guess = (
        F.when((kind == "congregational_music") & (before.eqNullSafe(sermon) | after.eqNullSafe(sermon)), "Continuación del sermón")
        .when((kind == "other") & before.eqNullSafe(sermon), "Transición posterior al sermón")
        .when(kind == "prayer", "Oración congregacional")
        .otherwise("Sección por revisar")
    )
    return sections.withColumn("title", F.when(F.col("confidence") < least, guess).otherwise(F.col("title")))


# --- identities -------------------------------------------------------------------------------------


def identity_scores(hits_: DataFrame, runs: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """keys, cluster, presence, longest, score: how much of a recording an identity fills, in all and in its longest run, how central and large it is.

    hits have keys, cluster, t, center, area, step; runs (keys, cluster, start, end) are their stretches, a step longer than their last hit.
    """
    length = F.max(F.greatest(F.lit(1.0), duration)).alias("_d")
    mid = F.avg(F.col("t").between(0.2 * duration, 0.8 * duration).cast("int")).alias("mid")
    seen = hits_.groupBy(*keys, "cluster").agg(F.sum("step").alias("presence"), F.avg("center").alias("center"), F.avg("area").alias("area"), mid, length)
    long = runs.groupBy(*keys, "cluster").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    both = seen.join(long, [*keys, "cluster"])
    share = lambda c: F.least(F.lit(1.0), F.col(c) / F.col("_d"))
    score = 0.45 * share("longest") + 0.30 * share("presence") + 0.10 * F.col("center") + 0.10 * F.least(F.lit(1.0), F.col("area") * 12.0) + 0.05 * F.col("mid")
    return both.select(*keys, "cluster", "presence", "longest", F.round(score, 6).alias("score"))


def significant_bounds(runs: DataFrame, keys: list[str], least: float, share: float, back: float) -> DataFrame:
    """keys, start, end over the runs of an identity that are long, absolutely and against the longest; starts lie at most ``back`` before that of the longest."""
    length = F.col("end") - F.col("start")
    top = runs.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct(length, -F.col("start"))).alias("_main"))
    rows = runs.join(top, keys).withColumn("_sig", length >= F.greatest(F.lit(least), F.greatest(F.lit(1.0), F.col("_main.end") - F.col("_main.start")) * share))
    sig = F.col("_sig")
    out = rows.groupBy(*keys).agg(
        F.first("_main").alias("_main"), F.min(F.when(sig & (F.col("start") >= F.col("_main.start") - back), F.col("start"))).alias("_a"), F.min(F.when(sig, F.col("start"))).alias("_s"), F.max(F.when(sig, F.col("end"))).alias("_b")
    )
    return out.select(*keys, F.coalesce("_a", "_s", "_main.start").alias("start"), F.coalesce("_b", "_main.end").alias("end"))


def pick_faces(faces: DataFrame, keys: list[str], t: str, margin: float = 0.06, least_height: float = 0.0, weights: tuple[float, float, float] = (0.08, 0.12, 0.05)) -> DataFrame:
    """The best face of each time: near the best identity and not much smaller than the largest (if any is), by a weighted sum with talk scaled by its largest value.

    faces have id, identity, height, active, prev, center, area, talk, motion; weights: active, talk, motion.
    """
    w = W.partitionBy(*keys, t)
    best = faces.withColumn("_best", F.max("identity").over(w)).withColumn("_tall", F.max("height").over(w))
    keep = (F.col("identity") >= F.col("_best") - margin) & ((F.col("height") >= least_height) | (F.col("height") >= F.col("_tall") * 0.85))
    rows = best.withColumn("_keep", keep).withColumn("_any", F.max(F.col("_keep").cast("int")).over(w) == 1).where(F.col("_keep") | ~F.col("_any"))
    rows = rows.withColumn("_talk", F.col("talk") / F.greatest(F.lit(1e-6), F.max("talk").over(w)))
    active, talk, motion = weights
    c = F.col
    score = 0.50 * c("identity") + active * c("active") + 0.14 * c("prev") + 0.06 * c("center") + 0.10 * c("area") + talk * c("_talk") + motion * c("motion")
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.groupBy(*keys, t).agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("_p")).select(*keys, t, "_p.id", "_p.score")


def speaker_bounds(turns: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, speaker, around_start, around_end) with start and end of the speaker's turns that hold those times, else of the nearest ones.

    Of turns that hold a time the earliest counts: the first one in order of its end among those that end later than all before them. So
    as-of joins do, and no question meets all turns of its speaker.
    """
    own = [*keys, "speaker"]
    rows = turns.select(*own, "start", "end")
    order = W.partitionBy(*own).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    latest = rows.withColumn("_reach", reach).where("_reach is null or end > _reach").select(*own, F.col("start").alias("held_start"), F.col("end").alias("held_end"))
    out = asked
    for name, side in (("around_start", "start"), ("around_end", "end")):
        out = as_of(out, latest, own, name, "held_end", ["held_start", "held_end"], forward=True, prefix="_")
        out = nearest(out, rows.select(*own, F.col(side).alias("_side")), own, name, "_side", "_near")
        held = F.col("_held_start") <= F.col(name)
        out = out.withColumn(side, F.when(held, F.col(f"_held_{side}")).otherwise(F.col("_near"))).drop("_held_start", "_held_end", "_near")
    return out.where("start is not null")


def chains(turns: DataFrame, keys: list[str], gap: float = 1.5, pad: float = 0.2, least: float = 0.35, width: float = 30.0) -> DataFrame:
    """turns with ``chain``: a new one for each speaker after a pause over ``gap``, or where another one speaks for ``least`` about the pause."""
    order = W.partitionBy(*keys, "speaker").orderBy("start", "id")
    rows = turns.withColumn("_was", F.lag("end").over(order))
    about = rows.where("_was is not null").select(*keys, F.col("id").alias("tid"), F.col("speaker").alias("_own"), (F.least("_was", "start") - pad).alias("start"), (F.greatest("_was", "start") + pad).alias("end"))
    others = turns.select(*keys, F.col("speaker").alias("_other"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    cut = F.least("end", "r_end") - F.greatest("start", "r_start") >= least
    between = interval_join(about, others, keys, width).where((F.col("_own") != F.col("_other")) & cut).select(*keys, F.col("tid").alias("id")).distinct().withColumn("_other", F.lit(True))
    new = F.col("_was").isNull() | (F.col("start") - F.col("_was") > gap) | F.coalesce("_other", F.lit(False))
    marked = rows.join(between, [*keys, "id"], "left").withColumn("_new", new.cast("int"))
    return marked.withColumn("chain", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_was", "_other", "_new")


def chain_starts(turns: DataFrame, asked: DataFrame, keys: list[str], back: float = 120.0, ahead: float = 25.0, width: float = 150.0) -> DataFrame:
    """asked (keys, speaker, guess) with ``start``: that of the chain that leads to the speaker's turn at the guess, else to the next or the last one near it.

    Only turns from ``back`` before the guess to ``ahead`` after it count; without any the guess stays.
    """
    own = [*keys, "speaker"]
    frames = asked.select(*own, "guess", (F.col("guess") - back).alias("start"), (F.col("guess") + ahead).alias("end"))
    right = chains(turns, keys).select(*own, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "chain")
    pairs = interval_join(frames, right, own, width, touches)
    g, a, b = F.col("guess"), F.col("r_start"), F.col("r_end")
    kind = F.when((a <= g) & (b >= g), 0).when(a >= g, 1).otherwise(2)
    anchor = F.min(F.struct(kind.alias("kind"), F.when(kind < 2, a).otherwise(-a).alias("order"), a.alias("at"), F.col("chain").alias("chain")))
    near = pairs.groupBy(*own, "guess").agg(anchor.alias("_a"), F.collect_list(F.struct(a.alias("at"), "chain")).alias("_near"))
    walked = F.array_min(F.transform(F.filter("_near", lambda x: (x["chain"] == F.col("_a.chain")) & (x["at"] <= F.col("_a.at"))), lambda x: x["at"]))
    return asked.join(near.select(*own, "guess", walked.alias("start")), [*own, "guess"], "left").withColumn("start", F.coalesce("start", "guess"))


def chain_ends(turns: DataFrame, asked: DataFrame, keys: list[str], back: float = 40.0, ahead: float = 120.0, width: float = 160.0) -> DataFrame:
    """asked (keys, speaker, guess) with ``end``: that of the chain that leads on from the speaker's turn at the guess, else from the last one that
    ends before it, else from the first one near it.

    Only turns from ``back`` before the guess to ``ahead`` after it count; without any the guess stays.
    """
    own = [*keys, "speaker"]
    frames = asked.select(*own, "guess", (F.col("guess") - back).alias("start"), (F.col("guess") + ahead).alias("end"))
    right = chains(turns, keys).select(*own, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("_rid"), "chain")
    pairs = interval_join(frames, right, own, width, touches)
    g, a, b = F.col("guess"), F.col("r_start"), F.col("r_end")
    kind = F.when((a <= g) & (b >= g), 0).when(b <= g, 1).otherwise(2)
    anchor = F.min(F.struct(kind.alias("kind"), F.when(kind == 1, -a).otherwise(a).alias("order"), F.when(kind == 1, -F.col("_rid")).otherwise(F.col("_rid")).alias("tie"), a.alias("at"), F.col("chain").alias("chain")))
    near = pairs.groupBy(*own, "guess").agg(anchor.alias("_a"), F.collect_list(F.struct(a.alias("at"), F.col("_rid").alias("rid"), b.alias("end"), "chain")).alias("_near"))
    walked = F.array_max(F.filter("_near", lambda x: (x["chain"] == F.col("_a.chain")) & (x["at"] >= F.col("_a.at"))))
    return asked.join(near.select(*own, "guess", walked["end"].alias("end")), [*own, "guess"], "left").withColumn("end", F.coalesce("end", "guess"))


def paragraph_sections(paragraphs: DataFrame, sections: DataFrame, keys: list[str], none: str = "Sin capítulo") -> DataFrame:
    """paragraphs (keys, island, start, ...) with section (the index of the one that holds their start, else of the nearest) and its title.

    sections have keys, index, start, end, title and don't overlap; a key without any has no section and the title ``none``.
    """
    points = paragraphs.select(*keys, F.col("island").alias("id"), F.col("start").alias("t"))
    found = locate(points, sections, keys).select(*keys, F.col("id").alias("island"), F.col("index").alias("section"))
    titles = sections.select(*keys, F.col("index").alias("section"), F.col("title").alias("section_title"))
    return paragraphs.join(found, [*keys, "island"], "left").join(titles, [*keys, "section"], "left").withColumn("section_title", F.coalesce("section_title", F.lit(none)))


@dataclass(frozen=True)
class TextGates:
    """Least shares of letters, of letters and digits, most of symbols; least confidence and number of samples, and a confidence that needs no more."""

    alpha: float = 0.5
    alnum: float = 0.6
    symbols: float = 0.2
    confidence: float = 0.5
    samples: int = 2
    sure: float = 0.8


def fused_segments(tracks: DataFrame, fused: DataFrame, keys: list[str], p: TextGates = TextGates()) -> DataFrame:
    """keys, track_key, region, start, end, text, type, confidence of the tracks (keys, track_key, region, start, end) whose fused text (keys, track_key,
    text, confidence, n, start, end) passes the gates; a segment reaches as far as track and text both do."""
    right = fused.select(*keys, "track_key", T.tidy(F.col("text")).alias("text"), "confidence", "n", F.col("start").alias("_start"), F.col("end").alias("_end"))
    text, sure = F.col("text"), F.col("confidence") >= p.sure
    clear = (T.alpha_ratio(text) >= p.alpha) & (T.alnum_ratio(text) >= p.alnum) & (T.symbol_ratio(text) <= p.symbols)
    rows = tracks.join(right, [*keys, "track_key"]).where((text != "") & clear & ((F.col("n") >= p.samples) | sure) & ((F.col("confidence") >= p.confidence) | sure))
    return rows.select(*keys, "track_key", "region", F.greatest("start", "_start").alias("start"), F.least("end", "_end").alias("end"), "text", T.on_screen_type(text, F.col("region")).alias("type"), "confidence")


# --- groups and summaries ---------------------------------------------------------------------------


def propagated(events: DataFrame, keys: list[str], better: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Events of a group with the text of its representative (else its first), where that was read anew and is better; adds propagated.

    events have id, representative, applied, text, confidence; better(text, confidence, its text, its confidence).
    """
    first = F.min_by(F.struct("id", "applied", "text", "confidence"), F.struct(~F.col("representative"), "id")).alias("_r")
    rows = events.join(events.groupBy(*keys).agg(first), keys)
    theirs, sure = T.clean(F.col("_r.text")), F.col("_r.confidence")
    take = F.col("_r.applied") & (theirs != "") & (F.col("id") != F.col("_r.id")) & ~F.col("applied") & better(F.col("text"), F.col("confidence"), theirs, sure)
    marked = rows.withColumn("propagated", take).withColumn("confidence", F.when(take, F.round(F.greatest("confidence", sure), 3)).otherwise(F.col("confidence")))
    return marked.withColumn("text", F.when(take, theirs).otherwise(F.col("text"))).drop("_r")


def summary(sections: DataFrame, keys: list[str], weak: float = 0.5) -> DataFrame:
    """keys, events, kinds, seconds, confidence, weak, last: what a run over a recording found."""
    length = F.col("end") - F.col("start")
    return sections.groupBy(*keys).agg(
        F.count("*").alias("events"), F.countDistinct("type").alias("kinds"), F.sum(length).alias("seconds"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("confidence") < weak).alias("weak"), F.max("end").alias("last")
    )
