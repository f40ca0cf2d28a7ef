"""The archive of meetings, their edited copies, and changes to both.

An archive is three tables: ``meetings(id, name, original_id, edited_id)``, ``segments`` and
``analyses(meeting_id, markdown, speakers_degraded)``. A change takes the tables and a batch of
requests and gives the tables back; of several requests for one meeting the one with the highest
``op_idx`` counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators.speakers import name_changes, rename_segments, rename_texts
from talkframe.session import cut


@dataclass(frozen=True)
class Archive:
    meetings: DataFrame
    segments: DataFrame
    analyses: DataFrame


def transcribed(archive: Archive) -> DataFrame:
    """Ids that have a transcript."""
    return archive.segments.select(F.col("meeting_id").alias("id")).distinct()


def originals(meetings: DataFrame) -> DataFrame:
    """Each id with the id of its original: ``(id, original)``."""
    return meetings.select("id", F.coalesce("original_id", "id").alias("original"))


def active_versions(archive: Archive) -> DataFrame:
    """Each id with its original and the version to show: ``(id, original, active)``.

    An edited copy counts when it points back at the original and has a transcript.
    """
    m = archive.meetings
    roots = originals(m)
    linked = m.select(F.col("id").alias("original"), "edited_id").filter(F.col("edited_id").isNotNull())
    copies = m.join(transcribed(archive), "id", "left_semi").select(F.col("id").alias("edited_id"), F.col("original_id").alias("original"))
    good = linked.join(copies, ["edited_id", "original"], "left_semi").select("original", "edited_id")
    return roots.join(good, "original", "left").select("id", "original", F.coalesce("edited_id", "original").alias("active"))


def meeting_list(archive: Archive) -> DataFrame:
    """Meetings to list: ``(id, created, name, has_edited, status)``; sort by ``created`` for newest first."""
    created = X.id_to_timestamp(F.col("id"))
    listed = archive.meetings.filter(created.isNotNull() & F.col("original_id").isNull()).join(transcribed(archive), "id", "left_semi")
    versions = active_versions(archive).select("id", "active")
    done = archive.analyses.filter(F.col("markdown").isNotNull()).select(F.col("meeting_id").alias("active")).distinct().withColumn("_done", F.lit(True))
    rows = listed.join(versions, "id").join(done, "active", "left")
    return rows.select(
        "id",
        created.alias("created"),
        X.display_name(F.col("name"), created, F.lit(False)).alias("name"),
        (F.col("active") != F.col("id")).alias("has_edited"),
        F.when(F.col("_done"), "done").otherwise("transcript-only").alias("status"),
    )


def newest_first(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.col("created").desc(), F.col("id"))


def meeting_details(archive: Archive, scopes: DataFrame) -> DataFrame:
    """One row per original: the active version's analysis, the original's scope and speakers."""
    heads = meeting_list(archive).drop("status")
    versions = active_versions(archive).filter(F.col("id") == F.col("original")).select("id", "active")
    spoken = archive.segments.groupBy(F.col("meeting_id").alias("id")).agg(F.max(F.coalesce(F.col("speaker") != "", F.lit(False))).alias("has_original_speakers"))
    notes = archive.analyses.select(F.col("meeting_id").alias("active"), "markdown", "speakers_degraded")
    scope = scopes.select(F.col("meeting_id").alias("id"), F.col("meeting_scope").alias("_scope"))
    joined = heads.join(versions, "id").join(notes, "active", "left").join(spoken, "id", "left").join(scope, "id", "left")
    return joined.select(
        "id",
        "active",
        "created",
        "name",
        "has_edited",
        "markdown",
        F.coalesce("speakers_degraded", F.lit(False)).alias("speakers_degraded"),
        F.coalesce("has_original_speakers", F.lit(False)).alias("has_original_speakers"),
        F.coalesce("_scope", F.lit("group")).alias("meeting_scope"),
    )


def display_names(archive: Archive) -> DataFrame:
    """Names as shown: an edited copy carries its original's name and a mark."""
    m = archive.meetings
    names = m.select(F.col("id").alias("original"), F.col("name").alias("_name"))
    joined = originals(m).join(names, "original", "left")
    created = X.id_to_timestamp(F.col("original"))
    return joined.select("id", X.display_name(F.col("_name"), created, F.col("id") != F.col("original")).alias("name"))


def saved_order(meetings: DataFrame, saved: DataFrame) -> DataFrame:
    """``meetings(id, pos)`` in the user's order ``saved(id, saved_pos)``: new ones first, deleted ones gone."""
    joined = meetings.join(saved, "id", "left")
    return joined.orderBy(F.col("saved_pos").asc_nulls_first(), "pos")


# --- changes -------------------------------------------------------------------------------------


def latest(requests: DataFrame, key: str = "id") -> DataFrame:
    """The last request per meeting."""
    rest = [c for c in requests.columns if c not in (key, "op_idx")]
    picked = requests.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), "op_idx").alias("_r"))
    return picked.select(key, "_r.*")


def edit_targets(archive: Archive, opened: DataFrame) -> DataFrame:
    """Where edits land: ``opened(id, new_id)`` gives ``(id, target, fresh)``.

    An edited copy is edited in place, an original's existing copy is reused, otherwise the new id
    becomes the copy. Two edits of one meeting share its first copy.
    """
    known = opened.join(archive.meetings.select("id", "original_id", "edited_id"), "id")
    first_new = F.when(F.col("original_id").isNull() & F.col("edited_id").isNull(), F.col("new_id"))
    return known.select(
        "id", F.when(F.col("original_id").isNotNull(), F.col("id")).otherwise(F.coalesce("edited_id", "new_id")).alias("target"), first_new.isNotNull().alias("fresh")
    )


def create_copies(archive: Archive, copies: DataFrame) -> Archive:
    """Add edited copies ``(id, new_id)`` of originals: transcript, analysis where there is one, both links."""
    wanted = copies.join(archive.meetings.select("id", "original_id"), "id").withColumn(
        "id", F.when(F.col("original_id").isNull(), F.col("id")).otherwise(F.raise_error(F.lit("an edited copy cannot be copied")).cast("string"))
    )
    wanted = wanted.select("id", "new_id")
    none = F.lit(None).cast("string")
    added = wanted.select(F.col("new_id").alias("id"), none.alias("name"), F.col("id").alias("original_id"), none.alias("edited_id"))
    linked = archive.meetings.join(wanted, "id", "left").withColumn("edited_id", F.coalesce("new_id", "edited_id"))
    by_meeting = wanted.select(F.col("id").alias("meeting_id"), "new_id")

    def copied(df: DataFrame) -> DataFrame:
        again = df.join(by_meeting, "meeting_id").withColumn("meeting_id", F.col("new_id")).select(*df.columns)
        return df.unionByName(again)

    columns = ["id", "name", "original_id", "edited_id"]
    return Archive(linked.select(*columns).unionByName(added), copied(archive.segments), copied(archive.analyses))


def _copied_where_needed(archive: Archive, opened: DataFrame) -> tuple[Archive, DataFrame]:
    targets = cut(edit_targets(archive, opened))
    fresh = targets.filter("fresh").select("id", F.col("target").alias("new_id"))
    return create_copies(archive, fresh), targets.select("id", "target")


def overwrite_analyses(analyses: DataFrame, written: DataFrame) -> DataFrame:
    """Analyses after ``written(meeting_id, markdown)``; what else is stored with one stays."""
    after = analyses.join(written.withColumnRenamed("markdown", "_new"), "meeting_id", "full")
    return after.select("meeting_id", F.coalesce("_new", "markdown").alias("markdown"), F.coalesce("speakers_degraded", F.lit(False)).alias("speakers_degraded"))


def save_analyses(archive: Archive, edits: DataFrame) -> Archive:
    """Save edited analyses ``(id, new_id, markdown, op_idx)`` on the edited copies."""
    edits = latest(edits)
    copied, targets = _copied_where_needed(archive, edits.select("id", "new_id"))
    written = edits.join(targets, "id").select(F.col("target").alias("meeting_id"), "markdown")
    return replace(copied, analyses=overwrite_analyses(copied.analyses, written))


def name_speakers(archive: Archive, entries: DataFrame) -> Archive:
    """Give speakers names ``(id, new_id, label, name)`` on the edited copies, in transcript and analysis.

    Entries that change nothing make no copy.
    """
    changed = name_changes(entries.withColumnRenamed("id", "meeting_id")).withColumnRenamed("meeting_id", "id")
    copied, targets = _copied_where_needed(archive, changed.groupBy("id").agg(F.min("new_id").alias("new_id")))
    names = changed.join(targets, "id").select(F.col("target").alias("meeting_id"), "label", "name")
    return replace(copied, segments=rename_segments(copied.segments, names), analyses=rename_texts(copied.analyses, names, "markdown"))


def rename_meetings(archive: Archive, names: DataFrame) -> Archive:
    """Rename pairs ``(id, name, op_idx)``: the name is kept on the original; a blank one is an error."""
    roots = names.join(originals(archive.meetings), "id").select(F.col("original").alias("id"), X.strip(F.col("name")).alias("_new"), "op_idx")
    refused = F.raise_error(F.lit("a meeting name must not be blank")).cast("string")
    fresh = latest(roots).withColumn("_new", F.when(F.col("_new") != "", F.col("_new")).otherwise(refused))
    renamed = archive.meetings.join(fresh, "id", "left").withColumn("name", F.coalesce("_new", "name"))
    return replace(archive, meetings=renamed.select(*archive.meetings.columns))


def _without(archive: Archive, gone: DataFrame) -> Archive:
    """The archive without ``gone(id)``; links to what is gone are cut."""
    ids = cut(gone.select("id").distinct())
    kept = archive.meetings.join(ids, "id", "left_anti")
    cut_links = ids.select(F.col("id").alias("edited_id")).withColumn("_gone", F.lit(True))
    unlinked = kept.join(cut_links, "edited_id", "left").withColumn("edited_id", F.when(F.col("_gone").isNull(), F.col("edited_id")))
    rows = ids.select(F.col("id").alias("meeting_id"))
    return Archive(
        unlinked.select(*archive.meetings.columns),
        archive.segments.join(rows, "meeting_id", "left_anti"),
        archive.analyses.join(rows, "meeting_id", "left_anti"),
    )


def delete_meetings(archive: Archive, ids: DataFrame) -> Archive:
    """Delete meetings: an edited copy goes alone, an original takes its copy along."""
    asked = ids.select("id").distinct().join(archive.meetings.select("id", "original_id", "edited_id"), "id")
    copies = asked.filter(F.col("original_id").isNull() & F.col("edited_id").isNotNull()).select(F.col("edited_id").alias("id"))
    return _without(archive, asked.select("id").unionByName(copies))


def revert_edits(archive: Archive, ids: DataFrame) -> Archive:
    """Drop the edited copies of meetings, named by either side."""
    roots = ids.select("id").distinct().join(originals(archive.meetings), "id").select(F.col("original").alias("id")).distinct()
    copies = roots.join(archive.meetings.select("id", "edited_id"), "id").filter(F.col("edited_id").isNotNull())
    return _without(archive, copies.select(F.col("edited_id").alias("id")))


def reanalyze(archive: Archive, results: DataFrame) -> Archive:
    """Put new analyses ``(id, markdown, op_idx)`` on the originals, then drop their edits."""
    roots = results.join(originals(archive.meetings), "id").select(F.col("original").alias("id"), "markdown", "op_idx")
    fresh = latest(roots)
    written = fresh.select(F.col("id").alias("meeting_id"), "markdown")
    return revert_edits(replace(archive, analyses=overwrite_analyses(archive.analyses, written)), fresh)

