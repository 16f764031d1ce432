"""Who a recording is, what was already done for it, and whether stored state can be trusted."""

from __future__ import annotations

import json
import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import scope_label
from ..settings import InferenceSettings, SegmentationSettings
from .ordered import neighbours, numbered

KEY_LENGTH = 12
KEY_BLOCK = 4 * 1024 * 1024
PREFIX_LENGTH = 8
# The files a finished version must have.
REQUIRED_ARTIFACTS = [
    "transcript.json",
    "transcript.txt",
    "transcript.md",
    "transcript.srt",
    "transcript.vtt",
    "report.json",
]
# The form of a version name.
VERSION_NAME = (
    r"^(\d{8}T\d{4}Z)_([a-z0-9.\-]+)_"
    r"(full|unknown|first\d+(?:p\d+)?s|from\d+(?:p\d+)?s-(?:rest|first\d+(?:p\d+)?s))_([0-9a-f]{8})$"
)


def source_key(content: Column, block: int = KEY_BLOCK) -> Column:
    """Identity of media bytes: a hash of the size, the head and the tail."""
    size = F.octet_length(content)
    head = F.substring(content, 1, block)
    tail = F.substr(content, F.greatest(F.lit(1), size - block + 1), F.lit(block))
    prefix = F.encode(F.concat(size.cast("string"), F.lit(":")), "UTF-8")
    return F.substring(F.sha2(F.concat(prefix, head, tail), 256), 1, KEY_LENGTH)


def metadata_key(size: Column, name: Column) -> Column:
    """Key of a recording that no longer exists, from its recorded size and name."""
    text = F.concat(F.lit("metadata:"), size.cast("string"), F.lit(":"), name)
    return F.substring(F.sha2(text, 256), 1, KEY_LENGTH)


def safe_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    kept = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.substring(F.when(kept == "", "media").otherwise(kept), 1, 64)


def model_slug(model: Column) -> Column:
    edges = r"^[-.]+|[-.]+$"
    slug = F.regexp_replace(
        F.regexp_replace(F.lower(F.coalesce(model, F.lit(""))), r"[^a-z0-9.]+", "-"), edges, ""
    )
    cut = F.regexp_replace(F.substring(slug, 1, 40), edges, "")
    return F.when(cut == "", "unknown").otherwise(cut)


def version_name(
    created: Column, model: Column, max_duration: Column, fingerprint: Column, start: Column
) -> Column:
    return F.concat_ws(
        "_",
        F.date_format(created, "yyyyMMdd'T'HHmm'Z'"),
        model_slug(model),
        scope_label(max_duration, start),
        F.substring(fingerprint, 1, PREFIX_LENGTH),
    )


def config_fingerprint(inference: InferenceSettings, segmentation: SegmentationSettings) -> str:
    """Hash of the settings that decide a result; optional ones only where they differ.

    Where a run happened is provenance and is left out.
    """
    optional = {
        "start_seconds": (inference.start_seconds, 0.0),
        "context_free_fallback": (inference.context_free_fallback, True),
        "collect_logprobs": (inference.collect_logprobs, False),
        "parallel_requests": (inference.parallel_requests, 1),
    }
    always = {
        k: v for k, v in vars(inference).items() if k not in optional and k not in ("runtime", "retries")
    }
    chosen = {k: value for k, (value, default) in optional.items() if value != default}
    cut = {k: v for k, v in vars(segmentation).items() if k != "block_frames"}
    text = json.dumps({**always, **chosen, "segmentation": cut}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def identify(sources: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """``sources(name, content, …)`` with key, stem and folder; the bytes stay behind."""
    key = source_key(F.col("content"), block)
    kept = [c for c in sources.columns if c != "content"]
    return sources.select(*kept, key.alias("source_key"), safe_stem(F.col("name")).alias("stem")).withColumn(
        "folder", F.concat_ws("-", "stem", "source_key")
    )


def file_key(path: str, block: int = KEY_BLOCK) -> str:
    """The same key as ``source_key`` from two ranges of a stored file; the rest is not read."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        size = source.size()
        head = source.read_at(min(block, size), 0)
        tail = source.read_at(min(block, size), max(0, size - block))
    return hashlib.sha256(f"{size}:".encode() + head + tail).hexdigest()[:KEY_LENGTH]


def identify_files(listing: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """``listing(path, relative, …)`` with key, stem and folder, for files of any size."""

    def keys(paths: pd.Series) -> pd.Series:
        return pd.Series([file_key(p, block) for p in paths], dtype="str")

    key = F.pandas_udf(keys, "string")("path")
    return listing.withColumns({"source_key": key, "stem": safe_stem(F.col("relative"))}).withColumn(
        "folder", F.concat_ws("-", "stem", "source_key")
    )


def duplicates(identified: DataFrame) -> DataFrame:
    """Keys carried by more than one source: how many, and the first name."""
    return (
        identified.groupBy("source_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("name").alias("first_name"))
        .where(F.col("copies") > 1)
    )


def parse_versions(df: DataFrame, column: str = "name") -> DataFrame:
    """Split version names into created, model slug, scope (with seconds) and fingerprint prefix."""
    part = lambda i: F.regexp_extract(column, VERSION_NAME, i)
    known = F.col(column).rlike(VERSION_NAME)
    seconds = lambda pattern: F.expr(
        f"try_cast(replace(nullif(regexp_extract(scope, '{pattern}', 1), ''), 'p', '.') as double)"
    )
    return (
        df.withColumn("created", F.when(known, F.date_format(F.try_to_timestamp(part(1), F.lit("yyyyMMdd'T'HHmm'Z'")), "yyyy-MM-dd HH:mm")))
        .withColumn("model_slug", F.when(known, part(2)))
        .withColumn("scope", F.when(known, part(3)))
        .withColumn("fingerprint_prefix", F.when(known, part(4)))
        .withColumn("start_seconds", seconds("^from([0-9p]+)s-"))
        .withColumn("max_seconds", seconds("first([0-9p]+)s$"))
    )


# --- skip and resume ------------------------------------------------------------------------


def pending_sources(
    sources: DataFrame, versions: DataFrame, artifacts: DataFrame, *, force: bool = False
) -> DataFrame:
    """Sources without a completed version of the same key and fingerprint and all its files."""
    if force:
        return sources
    whole = (
        artifacts.where(F.col("name").isin(REQUIRED_ARTIFACTS))
        .groupBy("version")
        .agg(F.count_distinct("name").alias("files"))
        .where(F.col("files") == len(REQUIRED_ARTIFACTS))
    )
    finished = (
        versions.where(F.col("status") == "completed")
        .join(whole, "version", "left_semi")
        .select("source_key", "fingerprint")
        .distinct()
    )
    return sources.join(finished, ["source_key", "fingerprint"], "left_anti")


def pending_chunks(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned chunks still to do; chunks that failed before are tried again."""
    return plan.join(done.select("job_id", "chunk_idx"), ["job_id", "chunk_idx"], "left_anti")


def resumed_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("job_id").agg(F.count(F.lit(1)).alias("resumed_chunks"))


def propagate_keys(records: DataFrame, located: DataFrame) -> DataFrame:
    """Keys for ``records(record, name, size)``: own, else of the same name and size, else derived."""
    own = records.join(located.select("record", "source_key"), "record", "left")
    shared = (
        own.where(F.col("source_key").isNotNull())
        .groupBy("name", "size")
        .agg(F.max_by("source_key", "record").alias("shared_key"))
    )
    found = F.coalesce("source_key", "shared_key")
    return own.join(shared, ["name", "size"], "left").select(
        "record",
        "name",
        "size",
        F.coalesce(found, metadata_key(F.col("size"), F.col("name"))).alias("source_key"),
        F.when(found.isNotNull(), "content").otherwise("metadata").alias("basis"),
    )


def ambiguous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct (key, value) pairs of keys that map to more than one value."""
    pairs = df.select(*keys, value).distinct()
    clash = (
        pairs.groupBy(*keys)
        .agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        .where(F.col("__lo") != F.col("__hi"))
        .select(*keys)
    )
    return pairs.join(clash, list(keys), "left_semi")


def rekey_plan(records: DataFrame, folders: DataFrame, targets: DataFrame) -> DataFrame:
    """Dry run of moving legacy records under content keys.

    ``records(record, name, size, fingerprint, created, model, max_duration, located_key,
    migrated)``, ``folders(source_key, folder)`` already in use, ``targets(target)`` that exist.
    """
    keyed = propagate_keys(
        records.select("record", "name", F.coalesce("size", F.lit(0).cast("long")).alias("size")),
        records.where(F.col("located_key").isNotNull()).select(
            "record", F.col("located_key").alias("source_key")
        ),
    ).select("record", "source_key", "basis")
    usable = (
        ~F.col("migrated")
        & (F.length("fingerprint") >= PREFIX_LENGTH)
        & F.col("name").isNotNull()
        & F.col("created").isNotNull()
    )
    placed = (
        records.join(keyed, "record", "left")
        .join(folders.groupBy("source_key").agg(F.min("folder").alias("known")), "source_key", "left")
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn(
            "target",
            F.when(
                F.col("usable"),
                F.concat_ws(
                    "/",
                    F.coalesce("known", F.concat_ws("-", safe_stem(F.col("name")), "source_key")),
                    version_name(
                        F.col("created"), F.col("model"), F.col("max_duration"), F.col("fingerprint"), F.lit(0.0)
                    ),
                ),
            ),
        )
    )
    first = placed.where("usable").groupBy("target").agg(F.min("record").alias("claimed_by"))
    checked = placed.join(first, "target", "left").join(
        targets.select("target", F.lit(True).alias("exists")).distinct(), "target", "left"
    )
    clash = F.coalesce("exists", F.lit(False)) | (F.col("claimed_by") != F.col("record"))
    status = (
        F.when(F.col("migrated"), "already-migrated")
        .when(~F.col("usable"), "skipped")
        .when(clash, "conflict")
        .otherwise("move")
    )
    reason = (
        F.when(F.col("migrated"), "already a source folder")
        .when(F.col("name").isNull() | ~(F.coalesce(F.length("fingerprint"), F.lit(0)) >= PREFIX_LENGTH), "no fingerprint or source name")
        .when(F.col("created").isNull(), "no usable timestamp")
        .when(clash, "target exists or is claimed")
        .when(F.col("basis") == "metadata", "key derived from size and name")
        .otherwise("")
    )
    return checked.select("record", status.alias("status"), "target", F.when(F.col("usable"), F.col("basis")).alias("basis"), reason.alias("reason"))


# --- contracts ------------------------------------------------------------------------------


def key_violations(plan: DataFrame, done: DataFrame, failed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Chunks that are done, failed or attempted without being planned, or both done and failed."""
    tagged = None
    for table, kind in ((plan, "plan"), (done, "done"), (failed, "failed"), (attempts, "attempts")):
        part = table.select("job_id", "chunk_idx", F.lit(kind).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    flags = tagged.groupBy("job_id", "chunk_idx").agg(
        *[has(k).alias(k) for k in ("plan", "done", "failed", "attempts")]
    )
    problems = F.array_compact(
        F.array(
            *[
                F.when(F.col(k) & ~F.col("plan"), f"{k} outside the plan")
                for k in ("done", "failed", "attempts")
            ],
            F.when(F.col("done") & F.col("failed"), "done and failed"),
        )
    )
    return flags.select("job_id", "chunk_idx", F.explode(problems).alias("problem"))


ORDER_BLOCK = 1 << 16


def check_spans(df: DataFrame, kind: str) -> DataFrame:
    """Every span with the first rule it breaks (null when sound).

    ``plan``: ``(job_id, idx, start, end, duration)``; ``export`` adds ``text``;
    ``checkpoint`` (segments of chunks) and ``split`` (parts of a chunk) have
    ``(job_id, chunk_idx, idx, start, end, parent_start, parent_end)`` and text or a part label.
    """
    nested = kind in ("checkpoint", "split")
    keys = ["job_id", "chunk_idx"] if nested else ["job_id"]
    slack = 1e-3 if kind == "split" else 1e-6
    seen = neighbours(
        df,
        keys,
        ["idx"],
        F.floor(F.col("idx") / ORDER_BLOCK),
        before={"prev_end": F.col("end"), "prev_idx": F.col("idx")},
    )
    start, end = F.col("start"), F.col("end")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    floor = F.coalesce("prev_end", F.col("parent_start") if nested else F.lit(0.0))
    rules = [
        (bad(start) | bad(end), "times are not finite"),
        (start < floor - slack, "overlaps the span before it"),
        (end <= start, "ends before it starts"),
    ]
    if not nested:
        rules.append((start < 0, "starts before zero"))
    if kind == "plan":
        rules.append((F.col("idx") != F.coalesce("prev_idx", F.lit(-1)) + 1, "index is not contiguous"))
        rules.append((end > F.col("duration") + 0.05, "ends after the recording"))
    elif kind == "export":
        rules.append((end > F.col("duration") + slack, "ends after the recording"))
        rules.append((F.rint(end * 1000) <= F.rint(start * 1000), "shorter than a millisecond"))
    else:
        rules.append((start < F.col("parent_start") - slack, "starts before its chunk"))
        rules.append((end > F.col("parent_end") + slack, "ends after its chunk"))
    if kind in ("export", "checkpoint"):
        rules.append((F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == "", "text is blank"))
    if kind == "split":
        rules.append((F.coalesce(F.length("part"), F.lit(0)) == 0, "part has no label"))
    reason = None
    for broken, label in rules:
        reason = F.when(broken, label) if reason is None else reason.when(broken, label)
    return seen.withColumn("problem", reason).drop("prev_end", "prev_idx")


def accepted_documents(checked: DataFrame) -> DataFrame:
    """A document is taken whole or not at all: spans, broken spans, accepted."""
    return checked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count("problem").alias("broken"),
        F.bool_and(F.col("problem").isNull()).alias("accepted"),
    )


def file_set_difference(expected: DataFrame, archived: DataFrame) -> DataFrame:
    """Files on one side only: ``missing`` from the archive or ``unexpected`` in it."""
    tagged = expected.select("job_id", "name", F.lit(1).alias("side")).unionByName(
        archived.select("job_id", "name", F.lit(2).alias("side"))
    )
    return (
        tagged.groupBy("job_id", "name")
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .where(F.col("lo") == F.col("hi"))
        .select("job_id", "name", F.when(F.col("lo") == 1, "missing").otherwise("unexpected").alias("state"))
    )


def known_in_any(*roots: DataFrame) -> DataFrame:
    """Keys found in any of several roots, each once."""
    found = roots[0]
    for other in roots[1:]:
        found = found.unionByName(other)
    return found.distinct()


def verify_artifacts(public: DataFrame, canonical: DataFrame) -> DataFrame:
    """State of every published file against its canonical copy.

    ``public(job_id, name, size, content)``, ``canonical(job_id, name, size)``.
    """
    both = public.join(
        canonical.select("job_id", "name", F.col("size").alias("canonical_size")), ["job_id", "name"], "full_outer"
    )
    broken = F.col("name").endswith(".json") & F.expr("try_parse_json(content) is null")
    state = (
        F.when(F.col("size").isNull(), "missing")
        .when(F.col("size") == 0, "problem")
        .when(F.col("canonical_size").isNotNull() & (F.col("canonical_size") != F.col("size")), "problem")
        .when(broken, "problem")
        .otherwise("complete")
    )
    note = (
        F.when(F.col("size").isNull(), "not published")
        .when(F.col("size") == 0, "empty")
        .when(F.col("canonical_size").isNotNull() & (F.col("canonical_size") != F.col("size")), "differs in size")
        .when(broken, "not valid JSON")
        .when(F.col("canonical_size").isNotNull(), "matches the canonical copy")
        .otherwise("present")
    )
    return both.select("job_id", "name", "size", state.alias("state"), note.alias("note"))


def provenance(settings: InferenceSettings) -> Column:
    """The effective settings as one struct, attached to every output."""
    values = {k: v for k, v in vars(settings).items() if k not in ("retries", "runtime")}
    fields = [
        (F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)).alias(k)
        for k, v in sorted(values.items())
        if v is not None
    ]
    if settings.runtime:
        fields.append(F.struct(*[F.lit(v).alias(k) for k, v in settings.runtime.items()]).alias("runtime"))
    return F.struct(*fields)
