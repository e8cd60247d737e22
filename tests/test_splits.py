"""Splits of sections at greetings and preludes against plain loops."""

import random
import re

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import sections as O

SEGMENT = "key int, id long, start double, end double, text string"
SECTION = "key int, id int, start double, end double, title string, type string, confidence double"
SAID = ["Oremos, te lo pedimos.", "Vamos a cantar un himno.", "Abran sus biblias.", "Feliz sábado familia.", "nada", "Anuncios: hoy convivio.", "Recojamos la ofrenda.", "y dijo", "y luego", "El mensaje de hoy"]
has = lambda rx, t: bool(re.search(rx, t, re.IGNORECASE))


def tables(spark, seed):
    rnd = random.Random(seed)
    segments, sections = [], []
    for key in range(25):
        t = 0.0
        for i in range(rnd.randint(1, 40)):
            segments.append((key, i, t, t + rnd.choice([5.0, 9.0, 15.0]), rnd.choice(SAID[rnd.randint(0, 3) :])))
            t += 15.0
        cut = rnd.choice([0.0, t / 3])
        for n, (a, b) in enumerate([(0.0, cut), (cut, t)]):
            sections.append((key, n, a, b, rnd.choice(["Sermon one", "Part"]), rnd.choice(["sermon", "sermon", "other"]), rnd.choice([0.6, 0.9])))
    return segments, sections, spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(sections, SECTION)


def found(df):
    return sorted((r.key, r.id, r.start, r.end, r.title, r.type, r.confidence) for r in df.collect())


def test_preludes(spark):
    segments, sections, df, parts = tables(spark, 1)
    want, splits = [], 0
    for key, n, a, b, title, kind, sure in sections:
        own = sorted((s for s in segments if s[0] == key and s[3] >= a and s[2] <= b), key=lambda s: s[2])
        first = next((s[2] for s in own if has(O.PRELUDE_INTRO, s[4])), None)
        at = None if first is None else max(a, min(b, first))
        pre = [s for s in own if at is not None and s[2] < at]
        prayer, worship = sum(has(O.PRELUDE_PRAYER, s[4]) for s in pre), sum(has(O.PRELUDE_WORSHIP, s[4]) for s in pre)
        if kind == "sermon" and at is not None and len(own) >= 6 and b - a >= 120 and at - a >= 25 and b - at >= 90 and len(pre) >= 2 and prayer + worship >= 1 and (prayer + worship) / len(pre) >= 0.25:
            splits += 1
            song = worship > prayer
            want.append((key, n, a, at, "Alabanza congregacional" if song else "Oración y transición de adoración" if worship else "Oración congregacional", "congregational_music" if song else "prayer", round(max(0.72, sure - 0.08), 2)))
            want.append((key, n, at, b, title if has("sermon", title) else "Sermón principal", "sermon", sure))
        else:
            want.append((key, n, a, b, title, kind, sure))
    assert splits > 2 and found(O.split_prelude(parts, df, ["key"])) == sorted(want)


def test_greetings(spark):
    segments, sections, df, parts = tables(spark, 2)
    texts, cuts = {}, {}
    for key, n, a, b, _, kind, _ in sections:
        own = sorted((s for s in segments if s[0] == key and s[3] >= a and s[2] <= b), key=lambda s: s[2])
        at = next((s[2] for s in own if has(T.GREETING, s[4]) and s[2] >= a + 20 and s[3] <= b - 40), None)
        if b - a >= 80 and len(own) >= 2 and at is not None and b - at >= 40:
            cuts[key, n] = at
            texts[key, n, 0] = " ".join(s[4] for s in own if s[3] >= at - 90 and s[2] < at), kind
            texts[key, n, 1] = " ".join(s[4] for s in own if s[2] <= at + 90 and s[3] > at), kind
    rows = spark.createDataFrame([(*k, *v) for k, v in texts.items()], "key int, n int, side int, text string, kind string")
    kinds = {(r.key, r.n, r.side): r.found for r in rows.withColumn("found", T.section_type(F.col("text"), F.col("kind"))).collect()}
    named = {r.k: r.t for r in spark.createDataFrame([(k,) for k in {*kinds.values(), "other"}], "k string").withColumn("t", T.title_of(F.col("k"))).collect()}
    want, splits = [], 0
    for key, n, a, b, title, kind, sure in sections:
        at, one, two = cuts.get((key, n)), kinds.get((key, n, 0)), kinds.get((key, n, 1))
        if at is not None and (one != two or one in ("prayer", "congregational_music", "announcement", "offering")):
            splits += 1
            first = kind if one == two else one
            want.append((key, n, a, at, title if first == kind else named[first], first, sure))
            want.append((key, n, at, b, f"{title} (reinicio)" if two == kind else named[two], two, round(max(0.72, sure), 2)))
        else:
            want.append((key, n, a, b, title, kind, sure))
    assert splits > 2 and found(O.split_at_greeting(parts, df, ["key"])) == sorted(want)


def test_cue_words_keep_every_hit(spark):
    """Patterns find in the shortened texts, joined in any way, what they find in the whole, and long texts without cues become short."""
    rnd = random.Random(8)
    said = "feliz sábado|sabado|la predicación|sermón|mensaje,|tema|abran sus biblias|abramos su|biblia|abra|palabra de dios|texto bíblico|vamos a|estudiar|oremos|inclinen el rostro|te lo pedimos|en el nombre de|jesús|amén|amen,ya|amén.|padre nuestro|señor te damos|gracias|equipo de|alabanza|abrazo al que está al|lado|saluda al que está a tu lado|ofrendas|oración final|¡que dios les bendiga!|invito al grupo de|póngaste|pónganse de pie|pasen aquí|pasen adelante|terminamos cantando|les queremos|agradecer|gracias pastor|cantar|hoy|¡ya|(no)|x|día|un|casa|-|écoro|a|de|el|que".split("|")
    texts = [" ".join(rnd.choices(said, k=rnd.randrange(1, 7))) for _ in range(1500)]
    rows = [(k, *rnd.choices(texts, k=3)) for k in range(1500)] + [(1500, "nada " * 3000, "", "amén")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string").select("id", F.concat_ws(" ", "a", "b", "c").alias("whole"), F.concat_ws(" ", *(O.cue_words(F.col(x)) for x in "abc")).alias("short"))
    patterns = [rx for some in O.CUES.values() for rx in some] + [O.GREETING, *O.HANDOFF_NEAR]
    wrong = sum(((O.hits(F.col("whole"), [rx]) != O.hits(F.col("short"), [rx])).cast("int") for rx in patterns), F.lit(0))
    assert df.where(wrong > 0).count() == 0
    assert df.where("id = 1500").select(F.length("short")).first()[0] < 50
