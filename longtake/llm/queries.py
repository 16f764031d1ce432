"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, lexical, mixing, near, nearest, privacy, quality_model, rules, shards, substrings, tokens
from .common import prepare, table, text_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run

    return register


_CONTROL_SQL = r"(\|(?:im_start|im_end|message|turn|startoftext|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"


@query(
    rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         length(regexp_replace(text, '([<\[])(\\*){_CONTROL_SQL}', '\1\\\2\3', 'g')) AS chars,
         length(regexp_replace(role, '([<\[])(\\*){_CONTROL_SQL}', '\1\\\2\3', 'g')) AS role_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 12 + 11 + 11 + role_chars END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    turns = turns.union(spark.range(2).select(F.lit(-1).cast("long"), "id", role, own))
    chats = chat.format_chats(turns)
    read = chats.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS_SQL}) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
running AS (
  SELECT *, source_size * 2 AS lim,
         coalesce(sum(source_size * 2) OVER w, 0) AS lims_before, coalesce(sum(weight) OVER w, 0) AS weights_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM sources
  WINDOW w AS (ORDER BY source_size * 2 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (total * 1.5::DOUBLE - lims_before) * weight >= lim * (weights - weights_before)::DOUBLE AS capped FROM running),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN lim::DOUBLE ELSE
           (total * 1.5::DOUBLE - coalesce(sum(lim) FILTER (capped) OVER (), 0)::DOUBLE) * weight
           / (weights - coalesce(sum(weight) FILTER (capped) OVER (), 0))::DOUBLE END AS target
  FROM marked),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated"""
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken)


_MEASURES_SQL = """[
  {'measure': 'symbols', 'margin': 80, 'value': CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END},
  {'measure': 'dup_lines', 'margin': 350, 'value': CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END},
  {'measure': 'repeats', 'margin': 250, 'value': CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END},
  {'measure': 'word_length', 'margin': 150, 'value': CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END}]"""


def _quantiles_sql(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
{name} AS (
  SELECT {by}measure, min(bucket) FILTER (below * 1000 >= every * 500) AS middle,
         min(bucket) FILTER (below * 1000 >= every * 850) AS high,
         max(every) AS size
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}measure) AS every
        FROM (SELECT {by}measure, bucket, count(*) AS n FROM buckets GROUP BY ALL))
  GROUP BY {by}measure)"""


@query(
    rf"""
WITH rows AS (SELECT row_number() OVER () AS r, * FROM documents),
split AS (
  SELECT r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS_SQL} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM rows),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (
  SELECT s.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (r)),
measured AS (SELECT *, unnest({_MEASURES_SQL}) AS m FROM counted),
buckets AS (
  SELECT r, lang, source, m.measure AS measure, m.value AS value, m.margin AS margin,
         CASE WHEN m.value < 16 THEN m.value ELSE (m.value >> (length(bin(m.value)) - 4)) << (length(bin(m.value)) - 4) END AS bucket
  FROM measured),"""
    + _quantiles_sql("own", "lang, source")
    + ","
    + _quantiles_sql("of_lang", "lang")
    + ","
    + _quantiles_sql("of_all", "")
    + """,
limits AS (
  SELECT o.lang, o.source, o.measure,
         (o.size * o.middle + 100 * ((l.size * l.middle + 100 * a.middle) // (l.size + 100))) // (o.size + 100) AS middle,
         (o.size * o.high + 100 * ((l.size * l.high + 100 * a.high) // (l.size + 100))) // (o.size + 100) AS high
  FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN of_all a ON o.measure = a.measure),
judged AS (
  SELECT b.r, bool_and(b.value <= x.high + 4 * (x.high - x.middle) + b.margin) AS within
  FROM buckets b JOIN limits x ON b.lang IS NOT DISTINCT FROM x.lang AND b.source IS NOT DISTINCT FROM x.source
    AND b.measure = x.measure
  GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND within AS kept
FROM counted JOIN judged USING (r)"""
)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rules.rated(table(spark, sf_dir, "documents"))
    return rated.select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query()
def op10_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return dealt.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_documents(spark, folder).drop("shard")


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


@query()
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query()
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


@query()
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"), 13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_FINITE_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)"


@query(
    f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE_SQL}),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.vec_id = r.vec_id AS own, a.label = r.label AS same,
         CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM rows a JOIN rows r ON len(a.e) = len(r.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND NOT own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query(
    f"""
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND {_FINITE_SQL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, r.e) DESC, r.vec_id) AS INTEGER) AS rank,
       r.vec_id, list_inner_product(q.e, r.e) AS score
FROM rows q JOIN rows r ON len(q.e) = len(r.e) AND q.vec_id <> r.vec_id
WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20"""
)
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_TERMS_SQL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
sized AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
asked AS (SELECT DISTINCT i, item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, docs),
scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // words))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
  WHERE doc_id IS NOT NULL AND item_id IS NOT NULL GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
