"""Queries for answer quality and sample features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import folded_words
from ..operators import quality, signal
from ..plans import views
from ..session import stage
from ..settings import DEFAULT
from .base import FRAMES, SAMPLES, SEGMENTS, Book, rounded

BOOK = Book()

_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


RESPONSES = """resp AS (
  SELECT doc_id, lang, text AS raw, CASE WHEN doc_id % 7 = 0 THEN CAST(json_object('transcript', text) AS VARCHAR)
    WHEN doc_id % 11 = 0 THEN 'language ' || lang || '<asr_text>' || text ELSE text END AS content,
    CASE WHEN doc_id % 50 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE WHEN doc_id % 7 = 0 THEN 'json' WHEN doc_id % 11 = 0 THEN 'tagged' ELSE 'plain' END AS mode FROM documents)"""


@BOOK.add(
    "WITH "
    + RESPONSES
    + f""", t AS (SELECT *, {_strip('raw')} AS stripped FROM resp)
SELECT doc_id, CASE WHEN finish_reason <> 'length' THEN stripped END AS text,
  CASE WHEN finish_reason <> 'length' AND mode = 'tagged' THEN lang END AS detected_language,
  CASE WHEN finish_reason = 'length' THEN 'degenerate' WHEN stripped = '' THEN 'no_speech' ELSE 'ok' END AS status,
  CASE WHEN finish_reason = 'length' THEN 'length' END AS reason FROM t"""
)
def col_3_normalise_responses(spark, sf):
    out = quality.normalise_responses(views.responses(spark, sf))
    return out.select("doc_id", "text", "detected_language", "status", "reason")


@BOOK.add(
    "WITH "
    + RESPONSES
    + f""", t AS (SELECT *, {_strip('raw')} AS stripped FROM resp)
SELECT doc_id, CASE WHEN finish_reason <> 'length' AND doc_id % 7 > 0 THEN stripped END AS text,
  CASE WHEN finish_reason = 'length' OR doc_id % 7 = 0 THEN 'degenerate' WHEN stripped = '' THEN 'no_speech' ELSE 'ok' END AS status,
  CASE WHEN finish_reason = 'length' THEN 'length' WHEN doc_id % 7 = 0 THEN 'invalid' END AS reason FROM t"""
)
def col_3_content_parts(spark, sf):
    """Content given as parts: text, something else, and a part without a type."""
    part = lambda kind, text: F.struct(F.lit(kind).cast("string").alias("type"), text.alias("text"))
    whole, half = F.col("content"), F.floor(F.length("content") / 2).cast("int")
    parts = F.array(
        part("text", F.substring(whole, F.lit(1), half)), part("image", F.lit("pixels")),
        part(None, F.substring(whole, half + 1, F.length("content"))),
    )
    raw = views.responses(spark, sf).withColumn("mode", F.when(F.col("mode") == "json", "json").otherwise("plain"))
    raw = raw.join(views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("plain")), "doc_id")
    out = quality.normalise_responses(raw.withColumn("content", F.coalesce("plain", F.lit(""))).withColumn("content", parts))
    return out.select("doc_id", "text", "status", "reason")


@BOOK.add(
    r"""WITH c AS (
  SELECT event_id, CASE k % 8 WHEN 0 THEN 'language None<asr_text>' WHEN 1 THEN 'language none' WHEN 2 THEN 'language None<asr_text> words'
    WHEN 3 THEN '  Language English <ASR_TEXT> hello ' WHEN 4 THEN 'no tag at all' WHEN 5 THEN 'language <asr_text>x'
    WHEN 6 THEN 'language German<asr_text>' ELSE 'language French<asr_text>' || event_type END AS content, k % 8 AS c, event_type
  FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events))
SELECT event_id, CASE c WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN 'hello' WHEN 5 THEN 'x' WHEN 6 THEN '' WHEN 7 THEN event_type END AS text,
  CASE c WHEN 3 THEN 'English' WHEN 6 THEN 'German' WHEN 7 THEN 'French' END AS detected_language,
  CASE WHEN c IN (0, 1, 6) THEN 'no_speech' WHEN c IN (2, 4) THEN 'degenerate' ELSE 'ok' END AS status FROM c"""
)
def col_3_tagged_responses(spark, sf):
    return _tagged(spark, sf, None)


@BOOK.add(
    r"""WITH c AS (SELECT event_id, k % 8 AS c, event_type FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events))
SELECT event_id, CASE c WHEN 1 THEN 'language none' WHEN 3 THEN 'hello' WHEN 4 THEN 'no tag at all' END AS text,
  CASE WHEN c IN (1, 3, 4) THEN 'english' END AS detected_language, CASE WHEN c IN (1, 3, 4) THEN 'ok' ELSE 'degenerate' END AS status FROM c"""
)
def col_3_forced_language(spark, sf):
    return _tagged(spark, sf, F.lit("english"))


def _tagged(spark, sf, forced):
    k = F.col("k") % 8
    content = (
        F.when(k == 0, "language None<asr_text>")
        .when(k == 1, "language none")
        .when(k == 2, "language None<asr_text> words")
        .when(k == 3, "  Language English <ASR_TEXT> hello ")
        .when(k == 4, "no tag at all")
        .when(k == 5, "language <asr_text>x")
        .when(k == 6, "language German<asr_text>")
        .otherwise(F.concat(F.lit("language French<asr_text>"), F.col("event_type")))
    )
    raw = views.attempts_events(spark, sf).select(
        "event_id", content.alias("content"), F.lit("stop").alias("finish_reason"), F.lit("tagged").alias("mode")
    )
    out = quality.normalise_responses(raw, forced)
    return out.select("event_id", "text", "detected_language", "status")


@BOOK.add()
def col_4_repetition_gate(spark, sf):
    return quality.repetition_gate(views.table(spark, sf, "documents")).select(
        "doc_id", F.round("compression_ratio", 6).alias("compression_ratio"), "loops"
    )


_WORDS = r"regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}_]+')"


@BOOK.add(
    f"SELECT doc_id, len({_WORDS})::INTEGER AS words, md5(array_to_string({_WORDS}, ' ')) AS folded FROM documents"
)
def col_5_folded_words(spark, sf):
    words = folded_words(F.col("text"))
    return views.table(spark, sf, "documents").select(
        "doc_id", F.size(words).alias("words"), F.md5(F.array_join(words, " ")).alias("folded")
    )


@BOOK.add(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT {_WORDS} AS w FROM benchmark),
pr AS (SELECT DISTINCT array_to_string(w[i:i+5], ' ') AS run FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM p WHERE len(w) >= 6)),
dr AS (SELECT doc_id, array_to_string(w[i:i+5], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 6))
SELECT DISTINCT doc_id FROM dr SEMI JOIN pr USING (run)"""
)
def join_6_find_echoes(spark, sf):
    return quality.find_echoes(
        views.table(spark, sf, "documents").select("doc_id", "text"),
        views.table(spark, sf, "benchmark"),
        "doc_id",
    )


@BOOK.add(
    f"""WITH c AS (SELECT conv_id, turn, {_WORDS} AS w, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, text FROM conversations),
q AS (SELECT conv_id, turn, w, CASE WHEN turn % 3 = 1 THEN w ELSE {_WORDS.replace('text', "coalesce(prev, '')")} END AS pw FROM c),
r AS (SELECT conv_id, turn, list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' ')) AS a,
  list_transform(range(1, len(pw) - 4), lambda i: array_to_string(pw[i:i+5], ' ')) AS b FROM q)
SELECT conv_id, turn, coalesce(list_has_any(a, b), FALSE) AS prompt_echo FROM r"""
)
def join_6_echoes_own_prompt(spark, sf):
    from ..operators.ordered import neighbours

    turns = neighbours(
        views.table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096),
        before={"prev": F.col("text")},
    )
    prompt = F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.coalesce("prev", F.lit("")))
    return quality.echoes_own_prompt(turns.withColumn("prompt", prompt)).select("conv_id", "turn", "prompt_echo")


_TYPED = """CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN CASE lang WHEN 'de' THEN ' GERMAN ' WHEN 'en' THEN 'english' WHEN 'es' THEN 'espanol' ELSE 'FRANCAIS' END
  WHEN 2 THEN CASE lang WHEN 'de' THEN 'Allemand' WHEN 'en' THEN 'INGLÉS' WHEN 'es' THEN 'Castellano' ELSE 'französisch' END
  WHEN 3 THEN lang || '-' || upper(lang) WHEN 4 THEN upper(lang) || '_XX' ELSE source END"""


def _typed(spark, sf):
    n, lang = F.col("doc_id") % 6, F.col("lang")
    english = F.when(lang == "de", " GERMAN ").when(lang == "en", "english").when(lang == "es", "espanol").otherwise("FRANCAIS")
    other = F.when(lang == "de", "Allemand").when(lang == "en", "INGLÉS").when(lang == "es", "Castellano").otherwise("französisch")
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.when(n == 0, lang)
        .when(n == 1, english)
        .when(n == 2, other)
        .when(n == 3, F.concat(lang, F.lit("-"), F.upper(lang)))
        .when(n == 4, F.concat(F.upper(lang), F.lit("_XX")))
        .otherwise(F.col("source"))
        .alias("typed"),
    )


@BOOK.add(
    f"SELECT doc_id, {_TYPED} AS typed, CASE WHEN doc_id % 6 <> 5 THEN lang END AS code FROM documents"
)
def join_8_normalise_language(spark, sf):
    return quality.normalise_language(_typed(spark, sf), "typed")


@BOOK.add(
    f"SELECT doc_id, {_TYPED} AS typed, CASE WHEN doc_id % 6 <> 5 AND lang IN ('de', 'en') THEN lang END AS code FROM documents"
)
def join_8_supported_language(spark, sf):
    return quality.normalise_language(_typed(spark, sf), "typed", ["de", "en"])


# --- signal ---------------------------------------------------------------------------------

RATE = 200


@BOOK.add(
    """WITH w AS (SELECT vec_id, embedding, unnest(range(0, CAST(ceil(len(embedding) / 24.0) AS BIGINT))) AS window_idx FROM embeddings)
SELECT vec_id, window_idx::INTEGER AS window_idx, 24 AS n, round(list_sum(list_transform(embedding[window_idx * 24 + 1 : window_idx * 24 + 24], lambda x: x::DOUBLE)), 6) AS total FROM w"""
)
def src_4_frame_windows(spark, sf):
    framed = signal.frame_windows(
        views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s")), "s", 24
    )
    return framed.select(
        "vec_id",
        "window_idx",
        F.size("samples").alias("n"),
        F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


LEVELS = (
    SAMPLES
    + """,
levels AS (
  SELECT rec_id, pos // 6 AS frame_idx, CASE WHEN sum(value * value) > 0 THEN
    greatest(-90.0::DOUBLE, 10.0::DOUBLE * log10(CAST(sum(value * value) AS BIGINT)::DOUBLE / count(*) / (32768.0::DOUBLE * 32768.0::DOUBLE))) ELSE -90.0::DOUBLE END AS level_db
  FROM samples GROUP BY rec_id, pos // 6)"""
)


@BOOK.add("WITH " + LEVELS + " SELECT rec_id, frame_idx, round(level_db, 6) AS level_db FROM levels")
def agg_13_frame_energy(spark, sf):
    return rounded(signal.frame_energy(views.samples(spark, sf), RATE), 6)


@BOOK.add(
    "WITH "
    + LEVELS
    + """, lim AS (SELECT rec_id, greatest(-55.0::DOUBLE, least(quantile_cont(level_db, 0.10) + 15.0::DOUBLE, quantile_cont(level_db, 0.95) - 6.0::DOUBLE)) AS t FROM levels GROUP BY rec_id),
d AS (SELECT l.*, t, (level_db - t) / 10.0::DOUBLE AS dl FROM levels l JOIN lim USING (rec_id))
SELECT rec_id, frame_idx, round(level_db, 6) AS level_db, round(t, 6) AS threshold_db,
  round(CASE WHEN dl >= 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, dl) ELSE 0.5::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE + dl) END, 6) AS prob FROM d"""
)
def win_8_energy_probability(spark, sf):
    levels = stage(signal.frame_energy(views.samples(spark, sf), RATE))
    return rounded(signal.energy_probability(levels, DEFAULT), 6)


@BOOK.add(
    "WITH "
    + SAMPLES
    + """, c AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id),
b AS (SELECT rec_id, n, i AS bin, i * n // 100 AS lo, (i + 1) * n // 100 AS hi FROM c, range(0, 100) t(i))
SELECT b.rec_id, b.bin, coalesce(max(abs(s.value)) / 32768.0::DOUBLE, 0.0::DOUBLE) AS peak FROM b
LEFT JOIN samples s ON s.rec_id = b.rec_id AND s.pos >= b.lo AND s.pos < b.hi GROUP BY b.rec_id, b.bin"""
)
def agg_14_waveform(spark, sf):
    return signal.waveform(views.samples(spark, sf), 100)


@BOOK.add(
    "WITH "
    + FRAMES
    + """, b AS (SELECT rec_id, n, i AS bin, i * n // least(20, n) AS lo, (i + 1) * n // least(20, n) AS hi FROM recordings, range(0, 20) t(i) WHERE i < least(20, n))
SELECT b.rec_id, b.bin, round(max(f.prob), 2) AS peak FROM b JOIN frames f ON f.rec_id = b.rec_id AND f.frame_idx >= b.lo AND f.frame_idx < b.hi GROUP BY b.rec_id, b.bin"""
)
def agg_14_activity_curve(spark, sf):
    return signal.activity_curve(views.frames(spark, sf), 20)


@BOOK.add(
    "WITH "
    + SAMPLES
    + """, e AS (SELECT rec_id, pos, count(*) OVER (PARTITION BY rec_id) AS n,
  sum(value * value) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS energy FROM samples),
b AS (SELECT rec_id, n, arg_min(pos, (energy, abs(pos - (n // 2 - 2)), pos)) AS best FROM e
  WHERE pos >= greatest(0, CAST(floor(n * 0.3::DOUBLE) AS BIGINT) - 2) AND pos <= least(n - 5, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) - 2) GROUP BY rec_id, n)
SELECT rec_id, least(greatest(best + 2, 1), n - 1)::BIGINT AS cut FROM b"""
)
def win_10_split_point(spark, sf):
    return signal.split_point(views.samples(spark, sf), ["rec_id"], 100, window_seconds=0.05, min_seconds=0.5)


@BOOK.add(
    "WITH "
    + SEGMENTS
    + """, p AS (SELECT event_id AS point_id, user_id % 100 AS job_id, value::DOUBLE AS t FROM events)
SELECT p.job_id, p.point_id, p.t, min(s.seg_idx) AS cue_idx FROM p
LEFT JOIN segments s ON s.job_id = p.job_id AND s.start_s <= p.t AND p.t < s.start_s + s.len_s GROUP BY ALL"""
)
def join_7_cue_at(spark, sf):
    points = views.table(spark, sf, "events").select(
        (F.col("user_id") % 100).alias("job_id"), F.col("event_id").alias("point_id"), F.col("value").alias("t")
    )
    cues = views.segments(spark, sf).select("job_id", F.col("seg_idx").alias("cue_idx"), "start", "end")
    return signal.cue_at(points, cues)


@BOOK.add(
    "WITH "
    + SAMPLES
    + f""", n AS (SELECT rec_id, count(*) AS n, count(*) / {RATE}.0::DOUBLE AS duration FROM samples GROUP BY rec_id),
d AS (SELECT *, least(0.05::DOUBLE, duration) AS span FROM n),
b AS (SELECT *, least(duration * 0.35::DOUBLE, duration - span) AS lo FROM d),
c AS (SELECT rec_id, k, span, lo + ('0x' || substr(md5('7:' || rec_id || ':' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (greatest(lo, least(duration * 0.65::DOUBLE, duration - span)) - lo) AS start_s
  FROM b, (SELECT unnest(range(1, 25)) AS k)),
m AS (SELECT c.rec_id, k, start_s, span, max(abs(value)) AS peak, sqrt(sum(value * value) / count(*)::DOUBLE) AS mean
  FROM c JOIN samples s ON s.rec_id = c.rec_id AND pos >= floor(start_s * {RATE}) AND pos < floor(start_s * {RATE}) + {round(0.05 * RATE)} GROUP BY ALL),
w AS (SELECT * FROM (SELECT rec_id, k, start_s, start_s + span AS end_s, CASE WHEN peak > 0 THEN 20 * log10(peak / 32768.0::DOUBLE) ELSE -1e9 END AS peak_db,
  CASE WHEN mean > 0 THEN 20 * log10(mean / 32768.0::DOUBLE) ELSE -1e9 END AS mean_db FROM m) WHERE peak_db >= -45 AND mean_db >= -60),
one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY k) = 1),
two AS (SELECT w.* FROM w JOIN one USING (rec_id) WHERE w.k > one.k AND abs(w.start_s - one.start_s) >= 0.05 QUALIFY row_number() OVER (PARTITION BY w.rec_id ORDER BY w.k) = 1)
SELECT rec_id, CAST(sample_no AS INTEGER) AS sample_no, CAST(k AS INTEGER) AS attempt, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(peak_db, 6) AS peak_db, round(mean_db, 6) AS mean_db
FROM (SELECT 0 AS sample_no, * FROM one UNION ALL SELECT 1, * FROM two)"""
)
def win_17_sample_windows(spark, sf):
    found = signal.sample_windows(views.samples(spark, sf), RATE, 2, 0.05, 7)
    measures = {"start": "start_s", "end": "end_s", "peak_db": "peak_db", "mean_db": "mean_db"}
    return found.select("rec_id", "sample_no", "attempt", *[F.round(c, 6).alias(n) for c, n in measures.items()])


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
