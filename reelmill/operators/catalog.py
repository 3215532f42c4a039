"""File catalogue: snapshot sync, status changes, statistics.

Every operator maps a catalogue snapshot to the next one. A scan is judged against the snapshot taken
before it, so the result does not depend on the order in which files are visited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import suffix_of
from ..schemas import ALLOWED_TRANSITIONS, DATE_PATTERNS, FILES, MIME_BY_SUFFIX
from .ordering import first_row, position_of, sum_before, value_before

# --- derived file columns -----------------------------------------------------------------------


def with_mime_type(listing: DataFrame) -> DataFrame:
    """MIME type from the suffix, else the default of the media type. The table is a literal map."""
    table = F.create_map(*[F.lit(x) for pair in MIME_BY_SUFFIX.items() for x in pair])
    default = F.when(F.col("file_type") == "video", "video/mp4").otherwise("image/jpeg")
    return listing.withColumn("mime_type", F.coalesce(F.try_element_at(table, suffix_of(F.col("file_path"))), default))


def with_fast_hash(listing: DataFrame, size: str = "file_size", mtime: str = "mtime") -> DataFrame:
    """Digest of size and modification time: tells that a file changed without reading it."""
    return listing.withColumn("file_hash", F.md5(F.concat_ws("_", F.col(size).cast("string"), F.col(mtime).cast("string"))))


def with_content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """Digest of content that is already a column; see ``sources.listing`` for files."""
    return df.withColumn("content_hash", F.md5(F.col(content).cast("binary")))


def capture_time(tags: DataFrame, names: Sequence[str] = ("datetime_original", "datetime_digitized", "datetime"),
                 filesystem: str = "filesystem_time", literal_z_is_utc: bool = False) -> DataFrame:
    """Epoch seconds of the first readable tag, else of the file system, with its source.

    A text without offset is local to the session zone, also when it ends in a literal ``Z`` unless
    ``literal_z_is_utc`` is set. A tag that yields epoch 0 counts as unread.
    """

    def parsed(tag: Column) -> Column:
        text = F.trim(tag)
        reads = [F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]
        if literal_z_is_utc:
            reads[4] = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit(DATE_PATTERNS[-1]))
        seconds = F.unix_micros(F.coalesce(*reads)) / F.lit(1e6)
        return F.when(seconds != 0, seconds)

    found = F.coalesce(*[parsed(F.col(n)) for n in names])
    return tags.withColumn("creation_timestamp", F.coalesce(found, F.col(filesystem))).withColumn(
        "timestamp_source", F.when(found.isNotNull(), "exif").otherwise("filesystem")
    )


# --- sync ---------------------------------------------------------------------------------------


def removed_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalogue rows whose path is gone, with the point ids to clean up."""
    gone = files.join(listing.select("file_path"), "file_path", "left_anti")
    return gone.select("id", "file_path", F.coalesce("point_ids", F.array().cast("array<string>")).alias("point_ids"))


def kept_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    return files.join(listing.select("file_path").distinct(), "file_path", "left_semi")


def cascade_timeline(timeline: DataFrame, files: DataFrame) -> DataFrame:
    """Timeline rows whose file is still catalogued."""
    return timeline.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def content_donors(files: DataFrame) -> DataFrame:
    """Per content hash the lowest id; it donates only if it is INDEXED and has points itself."""
    known = files.filter(F.col("content_hash").isNotNull())
    lowest = known.groupBy("content_hash").agg(
        F.min_by(F.struct("id", "status", "point_ids", "model_name", "model_version"), "id").alias("donor")
    )
    usable = (F.col("donor.status") == "INDEXED") & (F.size("donor.point_ids") > 0)
    return lowest.filter(usable).select(
        "content_hash",
        F.col("donor.id").alias("donor_id"),
        F.col("donor.point_ids").alias("donor_point_ids"),
        F.coalesce("donor.model_name", F.lit("siglip2")).alias("donor_model_name"),
        F.coalesce("donor.model_version", F.lit("1.0")).alias("donor_model_version"),
    )


def changed_listing(files: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """Listing rows whose content must be read: no row yet, another fast hash, or a forced scan."""
    if force:
        return listing
    same = files.select("file_path", "file_hash")
    return listing.join(same, ["file_path", "file_hash"], "left_anti")


def classify(files: DataFrame, listing: DataFrame, force: bool = False) -> DataFrame:
    """``action`` per listed file: skip, resume, reuse, modified or new.

    ``listing`` needs ``file_path``, ``file_hash`` and, for changed files, ``content_hash``. A forced
    scan of an unchanged indexed file finds itself as donor and is a reuse.
    """
    known = files.select(
        "file_path", F.col("id").alias("known_id"), F.col("file_hash").alias("known_hash"), F.col("status").alias("known_status")
    )
    donors = content_donors(files).withColumnRenamed("content_hash", "_donor_key")
    # files that were not read have no content hash: their own path spreads them over the join
    keyed = listing.join(known, "file_path", "left").withColumn("_donor_key", F.coalesce("content_hash", "file_path"))
    joined = keyed.join(donors, "_donor_key", "left").drop("_donor_key")
    same = F.coalesce(F.col("known_hash") == F.col("file_hash"), F.lit(False))
    unforced = F.lit(not force)
    action = (
        F.when(unforced & same & (F.col("known_status") == "INDEXED"), "skip")
        .when(unforced & same, "resume")
        .when(F.col("donor_id").isNotNull(), "reuse")
        .when(F.col("known_id").isNotNull() & ~same, "modified")
        .otherwise("new")
    )
    return joined.withColumn("action", action)


OVERWRITTEN = ("file_hash", "file_size", "file_type", "status")
KEPT_IF_MISSING = ("file_path", "content_hash", "mime_type", "creation_timestamp", "timestamp_source", "duration_seconds", "frame_count")


def upsert_files(files: DataFrame, changes: DataFrame, now: Column | None = None, also: Sequence[str] = (),
                 applies: str | None = None, how: str = "full") -> DataFrame:
    """Insert by path or overwrite: some columns always, some only when a value comes in.

    ``changes`` holds one row per path; ``id`` is used for new paths only. Columns in ``also`` are taken
    over when a value comes in. ``applies`` names a boolean column of the changes: rows where it is false
    leave the file as it is. With ``how="right"`` files without a row in ``changes`` are dropped.
    """
    now = F.lit(None).cast("double") if now is None else now
    joined = files.alias("old").join(changes.alias("new"), F.col("old.file_path") == F.col("new.file_path"), how)
    hit = F.col("new.file_path").isNotNull()
    if applies is not None:
        hit = hit & F.col(f"new.{applies}")
    incoming = set(changes.columns)
    cols = []
    for name in FILES.fieldNames():
        before = F.col(f"old.{name}")
        after = F.when(hit, F.col(f"new.{name}")) if name in incoming else F.lit(None).cast(FILES[name].dataType)
        if name in OVERWRITTEN:
            value = F.when(hit, after).otherwise(before)
        elif name in KEPT_IF_MISSING or name in also:
            value = F.coalesce(after, before)
        elif name == "scanned_at":
            value = F.coalesce(before, now)
        elif name == "updated_at":
            value = F.when(hit, now).otherwise(before)
        elif name == "id":
            value = F.coalesce(before, after)
        else:
            value = before
        cols.append(value.alias(name))
    return joined.select(*cols)


def _hash_slice() -> Column:
    """The first three digits of the path's digest: 4,096 slices that any engine can name."""
    return F.substring(F.md5("file_path"), 1, 3)


def assign_ids(new_rows: DataFrame, max_id: int | Column) -> DataFrame:
    """Consecutive ids after ``max_id`` in the order of (slice of the path's digest, path).

    The order is by hash so that the rows can be numbered slice by slice; the ids are repeatable.
    """
    hashed = new_rows.withColumn("_h", _hash_slice())
    placed = position_of(hashed, [], [F.col("_h"), F.col("file_path")], [F.col("_h")], "_n")
    start = max_id if isinstance(max_id, Column) else F.lit(max_id)
    return placed.withColumn("id", F.col("_n") + F.lit(1).cast("long") + start).drop("_n", "_h")


def apply_scan(files: DataFrame, classified: DataFrame, now: Column | None = None) -> DataFrame:
    """The catalogue after a full scan: changes applied, files that are gone removed."""
    return _apply(files, classified, now, "right")


def apply_changes(files: DataFrame, classified: DataFrame, now: Column | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Changed files are upserted, reused ones take their donor's points; files not listed stay.

    ``rows`` may hold just the catalogue rows of the listed paths; the result then holds those and the new ones.
    """
    return _apply(files, classified, now, "full", rows)


def _apply(files: DataFrame, classified: DataFrame, now: Column | None, how: str, rows: DataFrame | None = None) -> DataFrame:
    stamp = F.lit(None).cast("double") if now is None else now
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    judged = classified.withColumn("_h", _hash_slice())
    fresh = F.col("known_id").isNull().cast("long")
    numbered = sum_before(judged, [], [F.col("_h"), F.col("file_path")], [F.col("_h")], fresh, "_n").drop("_h")
    reused = F.col("action") == "reuse"
    changes = numbered.join(F.broadcast(top)).withColumns(  # one row
        {
            "id": F.col("_n") + F.col("_top") + F.lit(1).cast("long"),
            "status": F.when(reused, "INDEXED").otherwise("SCANNED"),
            "applies": F.col("action").isin("reuse", "modified", "new"),
            "point_ids": F.when(reused, F.col("donor_point_ids")),
            "model_name": F.when(reused, F.col("donor_model_name")),
            "model_version": F.when(reused, F.col("donor_model_version")),
            "embedded_at": F.when(reused, stamp),
        }
    )
    columns = [c for c in FILES.fieldNames() if c in changes.columns]
    return upsert_files(files if rows is None else rows, changes.select(*columns, "applies"), now, ("point_ids", "model_name", "model_version", "embedded_at"),
                        "applies", how)


def scan_summary(classified: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts over a classified listing and the snapshot it was judged against."""
    gone = removed_files(files, classified).select(F.lit("deleted").alias("action"), F.lit(None).cast("string").alias("file_type"))
    rows = classified.select("action", "file_type").unionByName(gone)

    def count(name: str, value: str) -> Column:
        return F.count_if(F.col(name) == value)

    return rows.agg(
        F.count_if(F.col("action") != "deleted").alias("total_found"),
        count("action", "new").alias("new_files"),
        count("action", "modified").alias("modified_files"),
        count("action", "skip").alias("skipped_files"),
        count("action", "reuse").alias("reused_files"),
        count("file_type", "image").alias("images_count"),
        count("file_type", "video").alias("videos_count"),
        count("action", "deleted").alias("deleted_files"),
    )


# --- reads --------------------------------------------------------------------------------------


def select_for_processing(files: DataFrame, force: bool = False) -> DataFrame:
    return files if force else files.filter(F.col("status") != "INDEXED")


def by_status(files: DataFrame, status: str) -> DataFrame:
    return files.filter(F.col("status") == status).orderBy("id")


def lookup(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("file_path") == path)


def lookup_by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(F.col("id") == file_id)


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("id")


def stats(files: DataFrame) -> DataFrame:
    """Total, per status and per type in one pass: ``grouping`` says which."""
    grouped = files.groupingSets([[], ["status"], ["file_type"]], "status", "file_type").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")
    )
    label = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "status").otherwise("file_type")
    return grouped.select(
        label.alias("grouping"), F.coalesce("status", "file_type", F.lit("")).alias("value"), "files", "bytes"
    )


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*cols).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def workspace_info(files: DataFrame, points: DataFrame) -> DataFrame:
    """Files, indexed files and vectors per workspace."""
    f = files.groupBy("workspace_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "INDEXED").alias("indexed_files")
    )
    p = points.groupBy("workspace_id").agg(F.count("*").alias("total_vectors"))
    zero = F.lit(0).cast("long")
    return f.join(p, "workspace_id", "full").select(
        "workspace_id", *[F.coalesce(c, zero).alias(c) for c in ("total_files", "indexed_files", "total_vectors")]
    )


# --- status changes -----------------------------------------------------------------------------


def update_status(files: DataFrame, changes: DataFrame, now: Column | None = None, check: bool = True) -> DataFrame:
    """Set status and error message by id; an unknown id is an error.

    ``changes``: ``id``, ``status`` and optionally ``error_message``. Of several changes of an id the last by ``changed_at``
    counts, or any one if there is no such column.
    """
    if "changed_at" in changes.columns:
        changes = first_row(changes, ["id"], [F.desc("changed_at"), F.desc("status")])
    else:
        changes = changes.dropDuplicates(["id"])
    if check:
        unknown = changes.join(files.select("id"), "id", "left_anti").select("id").limit(5).collect()
        if unknown:
            raise ValueError(f"File ids not found: {[r.id for r in unknown]}")
    message = F.col("error_message") if "error_message" in changes.columns else F.lit(None).cast("string")
    new = changes.select("id", F.col("status").alias("_status"), message.alias("_message"))
    hit = F.col("_status").isNotNull()
    joined = files.join(new, "id", "left")
    if now is not None:
        joined = joined.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return (
        joined.withColumn("status", F.coalesce("_status", "status"))
        .withColumn("error_message", F.when(hit, F.col("_message")).otherwise(F.col("error_message")))
        .drop("_status", "_message")
        .select(*files.columns)
    )


def mark_errors(files: DataFrame, errors: DataFrame, now: Column | None = None, check: bool = True) -> DataFrame:
    """Failed files become ERROR with their message; the others are untouched (``errors``: id, message)."""
    changes = errors.select("id", F.lit("ERROR").alias("status"), F.col("message").alias("error_message"))
    return update_status(files, changes, now, check)


def mark_indexed(files: DataFrame, points: DataFrame, model_name: str, model_version: str = "1.0",
                 now: Column | None = None) -> DataFrame:
    """Files that have points become INDEXED and list them all."""
    ids = points.groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_set("point_id")).alias("_ids"))
    hit = F.col("_ids").isNotNull()
    stamp = F.lit(None).cast("double") if now is None else now
    joined = files.join(ids, "id", "left")
    return joined.select(
        *[
            {
                "status": F.when(hit, "INDEXED").otherwise(F.col("status")),
                "model_name": F.when(hit, model_name).otherwise(F.col("model_name")),
                "model_version": F.when(hit, model_version).otherwise(F.col("model_version")),
                "point_ids": F.coalesce("_ids", "point_ids"),
                "embedded_at": F.when(hit, stamp).otherwise(F.col("embedded_at")),
                "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
            }.get(c, F.col(c)).alias(c)
            for c in files.columns
        ]
    )


def reset_embeddings(files: DataFrame, now: Column | None = None) -> DataFrame:
    """INDEXED and EMBEDDED rows go back to SCANNED and lose their embedding columns."""
    hit = F.coalesce(F.col("status").isin("INDEXED", "EMBEDDED"), F.lit(False))
    cleared = {c: F.when(~hit, F.col(c)) for c in ("model_name", "model_version", "point_ids", "embedded_at") if c in files.columns}
    if now is not None:
        cleared["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return files.withColumns({**cleared, "status": F.when(hit, "SCANNED").otherwise(F.col("status"))})


def transition_audit(status_log: DataFrame) -> DataFrame:
    """Status changes outside the declared edges (``status_log``: file_id, changed_at, status).

    The edges are declared but never enforced in the reference, so this reports and changes nothing.
    """
    edges = [f"{a}>{b}" for a, targets in ALLOWED_TRANSITIONS.items() for b in targets]
    day = F.floor(F.col("changed_at") / 86400)
    log = value_before(status_log, ["file_id"], ["changed_at", "status"], [day], F.col("status"), "from_status")
    edge = F.concat_ws(">", "from_status", "status")
    return log.filter(F.col("from_status").isNotNull() & ~edge.isin(edges))


def set_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Key/value metadata: the incoming value wins, the latest one among several of a key."""
    latest = first_row(changes, ["key"], [F.desc("updated_at"), F.desc("value")])
    return meta.join(latest.select("key"), "key", "left_anti").unionByName(latest)


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.filter(F.col("key") == key).select("value")


