"""Text cleaning, measures and classifiers as column expressions.

Patterns without Unicode word boundaries come as ``word(...)``: a boundary is then next to a
character other than A-Z, a-z, 0-9 and _, whatever the JVM's own notion of a word is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def word(pattern: str) -> str:
    """The pattern between ASCII word boundaries, any case."""
    return f"(?iu)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def anywhere(pattern: str) -> str:
    return f"(?iu)(?:{pattern})"


# --- cleaning -------------------------------------------------------------------------------------


def clean(text: Column) -> Column:
    """White space of any kind (also no-break spaces) to single spaces, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_bracketed(text: Column) -> Column:
    """As clean, but a text that is all ``[...]`` becomes empty."""
    cleaned = clean(text)
    return F.when(cleaned.rlike(r"^\[.*\]$"), F.lit("")).otherwise(cleaned)


def tidy(text: Column) -> Column:
    """As clean, without spaces in front of , . ; : ! ?"""
    return F.regexp_replace(clean(text), r"\s+([,.;:!?])", "$1")


def normal_key(text: Column) -> Column:
    """Lower case, only a-z, 0-9, Spanish letters and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(tidy(text)), "[^a-z0-9áéíóúñü ]+", ""), r"\s+", " "))


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters of the clean text, the last one an ellipsis if any were cut."""
    cleaned = clean(text)
    return F.when(F.length(cleaned) > most, F.concat(F.substring(cleaned, 1, most - 1), F.lit("…"))).otherwise(cleaned)


def join_tokens(tokens: Column) -> Column:
    """An array of tokens as text: no space in front of closing punctuation or after an opening bracket."""
    return F.regexp_replace(F.regexp_replace(F.array_join(tokens, " "), r"\s+([,.;:!?)\]}])", "$1"), r"([(\[{])\s+", "$1")


def _base_letters() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter or digit and marks, and what they decompose into."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2100)]
    some = [(c, x[0]) for c, x in found if len(x) > 1 and x[0].isascii() and x[0].isalnum() and all(map(unicodedata.combining, x[1:]))]
    return "".join(c for c, _ in some), "".join(x for _, x in some)


_ACCENTED, _PLAIN = _base_letters()


def slug(text: Column, default: str) -> Column:
    """Lower-case words joined by hyphens, accents removed; default if nothing stays."""
    bare = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _ACCENTED, _PLAIN), r"[\u0300-\u036f]", "")
    kebab = F.regexp_replace(F.trim(F.regexp_replace(F.lower(bare), r"[^a-z0-9\s-]", " ")), r"[\s_-]+", "-")
    kebab = F.regexp_replace(kebab, "^-+|-+$", "")
    return F.when(kebab == "", F.lit(default)).otherwise(kebab)


def string_list(text: Column, most_chars: int = 80) -> Column:
    """Comma-separated text to an array of clean, not empty strings of at most ``most_chars``."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), clean)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.substring(x, 1, most_chars))


def references(text: Column) -> Column:
    """At most 8 list entries of at least 3 characters."""
    return F.slice(F.filter(string_list(text), lambda x: F.length(x) >= 3), 1, 8)


# --- measures -------------------------------------------------------------------------------------


def _ratio(text: Column, kept: str) -> Column:
    """Share of characters that the negated class ``kept`` leaves."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, kept + "+", "")) / F.length(text))


def alpha_ratio(text: Column) -> Column:
    return _ratio(text, r"[^\p{L}]")


def alnum_ratio(text: Column) -> Column:
    return _ratio(text, r"[^\p{L}\p{N}]")


def symbol_ratio(text: Column) -> Column:
    """Characters that are neither letter, digit nor space; 1 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(_ratio(text, r"[\p{L}\p{N}\s]"))


def noise_ratio(text: Column) -> Column:
    """Share of ``| [ ] { } < > ~ _ =``; 1 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(_ratio(text, r"[^|\[\]{}<>~_=]"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it and whatever conditions it stands in."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of words of a tidy text: single spaces part them."""
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)


def _words_with(text: Column, least: int) -> Column:
    """Number of words of a tidy text that have at least so many letters or digits. Each word is tried at its first character only."""
    letter = "A-Za-zÁÉÍÓÚáéíóúÑñÜü0-9"
    return F.regexp_count(text, F.lit(f"(?<![^ ])(?:[^ {letter}]*+[{letter}]){{{least}}}"))


def word_shapes(text: Column) -> tuple[Column, Column, Column]:
    """Of a tidy text the numbers of words, of words with at least 3 letters or digits, and of words with at most 1."""
    n = word_count(text)
    return n, _words_with(text, 3), n - _words_with(text, 2)


def _up_to(text: Column, most: int, count: Callable[[Column], Column]) -> Column:
    """The smaller of ``most`` and count(text), of which a beginning has no more than the whole: most texts show ``most`` there."""
    return F.when(count(F.substring(text, 1, 500)) >= most, F.lit(most)).otherwise(F.least(F.lit(most), count(text)))


def alpha_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lexical_score(text: Column) -> Column:
    """Weighted quality of a short text: letters and digits, lack of noise, length, words, long words, letters."""

    def of(t: Column) -> Column:
        long, letters = _up_to(t, 6, lambda x: _words_with(x, 3)), _up_to(t, 60, alpha_count)
        score = (
            0.30 * alnum_ratio(t)
            + 0.22 * (1.0 - noise_ratio(t))
            + 0.16 * _unit(F.length(t) / 120.0)
            + 0.12 * _unit(word_count(t) / 10.0)
            + 0.10 * _unit(long / 6.0)
            + 0.10 * _unit(letters / 60.0)
        )
        return F.when(t == "", F.lit(0.0)).otherwise(F.round(_once(score, _unit) * 1_000_000) / 1_000_000)  # the last bit of a tie counts as in SQL

    return _once(tidy(text), of)


def keep_text(text: Column, confidence: Column, least_len: int, least_conf: float, alpha: float, alnum: float, symbols: float) -> Column:
    """Gate on length, presence of a letter or digit, the three ratios and confidence."""
    t = tidy(text)
    return (
        (F.length(t) >= max(1, least_len))
        & t.rlike("[A-Za-zÁÉÍÓÚáéíóúÑñ0-9]")
        & (alpha_ratio(t) >= alpha)
        & (alnum_ratio(t) >= alnum)
        & (symbol_ratio(t) <= symbols)
        & (confidence >= least_conf)
    )


def keep_hard(text: Column, alnum: float, noise: float, least_words: int, least_alpha: int) -> Column:
    def of(t: Column) -> Column:
        n, letters = word_count(t), _up_to(t, least_alpha + 2, alpha_count)
        return (
            (t != "")
            & (alnum_ratio(t) >= alnum)
            & (noise_ratio(t) <= noise)
            & ~((n < least_words) & (letters < least_alpha))
            & ~((F.length(t) >= 18) & (n < 2))
            & ~((letters < least_alpha + 2) & (_words_with(t, 3) == 0))
        )

    return _once(tidy(text), of)


def keep_fullscreen(text: Column, start: Column, end: Column, confidence: Column, least_sec: float, least_conf: float, least_chars: int, least_words: int, least_long: int, alnum: float, noise: float) -> Column:
    t = tidy(text)
    n, long, short = word_shapes(t)
    return (
        (F.greatest(F.lit(0.0), end - start) >= least_sec)
        & (confidence >= least_conf)
        & (F.length(t) >= least_chars)
        & (n >= least_words)
        & (long >= least_long)
        & (short <= F.greatest(F.lit(2), F.floor(n / 3)))
        & (alnum_ratio(t) >= alnum)
        & (noise_ratio(t) <= noise)
    )


def keep_rescued(text: Column, confidence: Column, kind: Column, least_conf: float, least_chars: int, kinds: list[str], keywords: str) -> Column:
    """Long and sure enough, and of a listed kind or with a keyword."""
    t = tidy(text)
    found = t.rlike(anywhere(keywords)) if keywords else F.lit(False)
    return (F.length(t) >= least_chars) & (confidence >= least_conf) & (F.lower(F.trim(kind)).isin(kinds) | found)


def cloud_override(local: Column, local_conf: Column, cloud: Column, cloud_conf: Column, gain: float) -> Column:
    """Whether a second reading of a text should replace the first."""
    a, b = tidy(local), tidy(cloud)
    qa, qb = lexical_score(local), lexical_score(cloud)
    better = (a == "") | (qb >= qa + max(0.0, gain)) | ((cloud_conf >= local_conf + 0.14) & (qb >= qa - 0.02))
    return (b != "") & (better | ((F.length(b) >= F.floor(F.length(a) * 1.35)) & (qb >= qa)))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts that normal_key has been applied to; 0 if either is empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


# --- classifiers ----------------------------------------------------------------------------------

# Word lists and patterns that decide the class of a text.
NON_SPEECH_WORDS = ["music", "música", "piano", "silence", "silencio"]
NON_SPEECH_STARTS = "music|música|piano|instrumental|aplausos|applause|silence|silencio"
SPEECH_LABELS = ["male", "female", "speech"]
LYRIC_KEYWORDS = [
    "dios", "jesus", "jesús", "cristo", "señor", "senor", "alaba", "alabanza", "adorar", "adoración", "adoracion", "gloria",
    "santo", "santa", "espiritu", "espíritu", "gracia", "amor", "salvador", "aleluya", "amen", "amén", "quiero", "eres",
    "tu", "tú", "mi", "alma", "corazón", "corazon", "cantar", "cantare", "cantaré", "alabarte", "adorarte", "sublime",
    "nombre",
]
CALL_TO_WORSHIP = r"lleg[oó]\s+el\s+momento\s+de\s+alabar|pong[aá]monos\s+de\s+pie.*(?:alabar|adorar)|les\s+invitamos\s+a\s+alabar|vamos\s+a\s+alabar"
GREETING = r"buenos d[ií]as[, ]+feliz s[áa]bado|feliz s[áa]bado(?:\s+(?:nuevamente|familia|iglesia|hermanos?|a todos))?"
PRAYER = r"oremos|oraci[oó]n|inclinemos|inclinar.*rostro|arrodill|te lo pedimos|en el nombre de (tu hijo )?cristo jes[uú]s|(?<![A-Za-z0-9_])am[eé]n(?![A-Za-z0-9_])"
PRAYER_TEXT = PRAYER + r"|padre (nuestro|que est[aá]s)"
MUSIC = r"vamos a cantar|cantemos|equipo de alabanza|alabemos|worship|himno|coro|reproclamamos|en lo alto est[aá]s"
WORSHIP_TEXT = MUSIC + "|tu nombre"
SERMON = r"mensaje de hoy|tema de hoy|hoy quiero (?:decirte|compartir)|quiero comenzar dici[eé]ndote|vamos a estudiar la palabra|abran? (sus )?biblias|quiero preguntar"
KICKOFF_TEXT = SERMON + r"|predicaci[oó]n|serm[oó]n principal"
OFFERING = r"diezmo[s]?|ofrenda[s]?|mayordom[ií]a|regresar lo que te pertenece"
ANNOUNCEMENT = r"anuncios?|announcement|actividades|recuerden|les invitamos|esta tarde|despu[eé]s del culto|hoy tenemos|les queremos agradecer"
TITLES = {
    "sermon": "Sermón principal",
    "prayer": "Oración congregacional",
    "congregational_music": "Alabanza congregacional",
    "offering": "Ofrendas y diezmos",
    "announcement": "Anuncios",
    "welcome": "Bienvenida",
}
TEXT_CUES = [
    ("sabbath_greeting_boundary", "other", r"buenos d[ií]as[, ]+feliz s[áa]bado|feliz s[áa]bado(?:\s+nuevamente|\s+familia)?"),
    ("invite_pray", "prayer", r"inclinar.*rostro|pong[aá]monos de rodillas|oremos"),
    ("prayer_close", "prayer", r"te lo pedimos en cristo jes[uú]s|en el nombre de jes[uú]s|am[eé]n\\.?$"),
    ("invite_sing", "congregational_music", r"vamos a cantar|cantemos|equipo de alabanza|alabemos"),
    ("offering_invite", "offering", r"diezmo[s]?|ofrenda[s]?|regresar lo que te pertenece|mayordom[ií]a"),
    ("call_to_worship", "call_to_worship", r"llamado a la adoraci[oó]n|pong[aá]monos de pie para adorar"),
    ("child_presentation", "child_presentation", r"niñ[oa]s?|historia infantil|momento de los niñ[oa]s|pasen los niñ[oa]s|presentaci[oó]n infantil"),
]
HOOKS = ["question", "promise", "scripture", "story", "contrast", "none"]
VERSE = (
    r"(gen(?:e?si?s)?|éxodo|exodo|lev[ií]tico|n[úu]meros|deuteronomio|josu[eé]|jueces|rut|samuel|reyes|cr[oó]nicas|esdras|nehem[ií]as|ester|job|salmo[s]?|"
    r"proverbios|isa[ií]as|jerem[ií]as|ezequiel|daniel|oseas|joel|am[oó]s|abd[ií]as|jon[aá]s|miqueas|nah[uú]m|habacuc|sof[oó]n[ií]as|hageo|zacar[ií]as|"
    r"malaqu[ií]as|mateo|marcos|lucas|juan|hechos|romanos|corintios|g[aá]latas|efesios|filipenses|colosenses|tesalonicenses|timoteo|tito|filem[oó]n|"
    r"hebreos|santiago|pedro|judas|apocalipsis)\s+\d{1,3}[:.]\d{1,3}(?:\s*[-–]\s*\d{1,3})?"
)
TITLE_CUE = r"tema|t[ií]tulo|serie|mensaje|predicaci[oó]n|serm[oó]n"
NAME_CUE = r"pr\.?|pastor|anciano|hno\.?|hna\.?|elder"
LYRIC_CUE = r"cantemos|alabemos|adoraci[oó]n|alabanza|santo|gloria|jes[uú]s|se[ñn]or"
OVERLAY = (
    r"pr\.?|pastor|bienvenida|iglesia|ministerio|predicador|hno\.?|hna\.?|worship|adoraci[oó]n infantil|vers[ií]culo b[ií]blico|escuela sab[aá]tica"
)
VERSE_CUE = r"vers[ií]culo b[ií]blico|texto b[ií]blico|lectura b[ií]blica|santa biblia"
SLIDE_TITLE_CUE = r"tema|t[ií]tulo|mensaje|predicaci[oó]n|serm[oó]n|sermon"
AUDIO_LABELS = [
    ("music", r"music|música|musica|song|singing|sings|hymn|choir|instrument|piano|guitar|organ|worship|canto|cantando|canci[oó]n"),
    ("noenergy", r"silence|silent|pausa|pause|quiet|no.?sound|mute|sin audio|sin sonido"),
    ("speech", r"speech|talking|speaking|voice|spoken|habla|hablando"),
]


def non_speech(text: Column) -> Column:
    """Empty, a listed word, all in brackets or parentheses, or beginning with a listed word."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    starts = f"^(?:{NON_SPEECH_STARTS})(?![A-Za-z0-9_])"
    return (t == "") | t.isin(NON_SPEECH_WORDS) | t.rlike(r"^\[.*\]$|^\(.*\)$") | t.rlike(starts)


def non_speech_exact(text: Column, listed: list[str]) -> Column:
    """Empty or exactly a listed word; brackets mean nothing here."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return (t == "") | t.isin(listed)


def speech_like(label: Column) -> Column:
    return F.lower(label).isin(SPEECH_LABELS)


def section_type(text: Column, default: Column) -> Column:
    t = F.lower(clean(text))
    rules = [(CALL_TO_WORSHIP, "congregational_music"), (PRAYER, "prayer"), (MUSIC, "congregational_music"), (SERMON, "sermon"), (OFFERING, "offering")]
    rules += [(ANNOUNCEMENT, "announcement"), (GREETING, "welcome")]
    out = F.when(t == "", default)
    for pattern, kind in rules:
        out = out.when(t.rlike(anywhere(pattern)), F.lit(kind))
    return out.otherwise(default)


def title_of(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, title in TITLES.items():
        out = out.when(kind == name, F.lit(title))
    return out.otherwise(F.lit("Transición"))


def cues(text: Column) -> Column:
    """Array of (kind, section) of the cue patterns that a text holds; none for a bare amen."""
    t = clean(text)
    found = [F.when(t.rlike(anywhere(rx)), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("section"))) for k, s, rx in TEXT_CUES]
    alone = t.rlike(r"(?iu)^am[eé]n\.?$")
    return F.when((t == "") | alone, F.array_compact(F.array(F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("section")))))).otherwise(F.array_compact(F.array(*found)))


def _on_screen(t: Column, region: Column) -> Column:
    n, found = word_count(t), words(t)
    name_shape = (n >= 2) & (n <= 7) & F.forall(found, lambda w: F.length(w) >= 2) & F.exists(found, lambda w: w.rlike(r"^\p{Lu}"))
    letter = "A-Za-zÁÉÍÓÚáéíóúÑñÜü"
    slide_name = t.rlike(r"\b[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+){1,3}\b") | t.rlike(f"(?:[{letter}]++[^{letter}]++){{5}}[{letter}]")
    is_name = t.rlike(rf"(?iu)\b({NAME_CUE})\b")
    return (
        F.when(t == "", "on_screen_text")
        .when(t.rlike("[0-9][:.][0-9]") & t.rlike(rf"(?iu)\b{VERSE}\b"), "bible_verse")  # every verse has such a place
        .when((region != "slide") & t.rlike(rf"(?iu)\b({TITLE_CUE})\b"), "sermon_title")
        .when((region == "lower_third") & (is_name | name_shape), "speaker_name")
        .when((region == "slide") & is_name & slide_name, "speaker_name")
        .when((n >= 4) & t.rlike(rf"(?iu)\b({LYRIC_CUE})\b"), "song_lyric")
        .otherwise("on_screen_text")
    )


def _lyric(t: Column, least_words: int) -> Column:
    n, edge = word_count(t), "[.,;:!?¡¿()\\[\\]{}\"']*+"
    one = f"(?:^| ){edge}(?:{'|'.join(LYRIC_KEYWORDS)}){edge}(?= |$)"
    low = F.lower(t)
    enough = F.when(n >= max(4, least_words), low.rlike(one)).otherwise(low.rlike(f"{one}.*{one}"))
    return (t != "") & (n >= max(1, least_words)) & ~t.rlike(rf"(?iu)\b({OVERLAY})\b") & enough


def _slide(t: Column, kind: Column) -> Column:
    return F.when(t == "", "on_screen_text").when(t.rlike(rf"(?iu)\b({VERSE_CUE})\b"), "bible_verse").when(t.rlike(rf"(?iu)\b({SLIDE_TITLE_CUE})\b"), "sermon_title").otherwise(kind)


def on_screen_type(text: Column, region: Column) -> Column:
    """Verse, then title (not on slides), then name (by region), then lyric, else generic."""
    return _once(tidy(text), lambda t: _on_screen(t, region))


def lyric_like(text: Column, least_words: int = 4) -> Column:
    return _once(tidy(text), lambda t: _lyric(t, least_words))


def slide_type(text: Column, region: Column) -> Column:
    return _once(tidy(text), lambda t: _slide(t, _on_screen(t, region)))


def lyrics_type(text: Column, region: Column) -> Column:
    return _once(tidy(text), lambda t: F.when(_lyric(t, 4), "song_lyric").otherwise(_on_screen(t, region)))


def on_screen_types(text: Column, region: Column) -> Column:
    """Struct of kind (``on_screen_type``), slide (``slide_type``) and lyrics (``lyrics_type``), which share a pass over the text."""

    def types(t: Column, kind: Column) -> Column:
        return F.struct(kind.alias("kind"), _slide(t, kind).alias("slide"), F.when(_lyric(t, 4), "song_lyric").otherwise(kind).alias("lyrics"))

    return _once(tidy(text), lambda t: _once(_on_screen(t, region), lambda kind: types(t, kind)))


def audio_label(raw: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[(){}\[\]]", ""))
    out = F.when(t == "", F.lit("noise"))
    for label, pattern in AUDIO_LABELS:
        out = out.when(t.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("noise"))


def speaker_label(raw: Column) -> Column:
    t = F.trim(raw)
    named = F.upper(F.regexp_replace(t, r"\s+", "_"))
    return F.when(t.isNull() | (t == ""), F.lit("SPEAKER_UNKNOWN")).when(t.rlike("(?i)^SPEAKER_"), F.upper(t)).when(t.rlike(r"^\d+$"), F.concat(F.lit("SPEAKER_"), t)).otherwise(F.concat(F.lit("SPEAKER_"), named))


def hook_type(raw: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(t.isin(HOOKS), t).otherwise(F.lit("none"))


def video_id(url: Column) -> Column:
    """The 11 characters after one of three url shapes; empty if there are none."""
    shapes = [r"youtube\.com/watch\?v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/shorts/([A-Za-z0-9_-]{11})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(F.trim(url), s, 1), F.lit("")) for s in shapes], F.lit(""))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """Number of matches of all patterns together."""
    return sum((F.regexp_count(text, F.lit(rx)) for rx in patterns), F.lit(0))


def patterns_present(text: Column, patterns: list[str]) -> Column:
    """Number of patterns with any match."""
    return sum(((F.regexp_count(text, F.lit(rx)) > 0).cast("int") for rx in patterns), F.lit(0))
