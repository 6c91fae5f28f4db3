"""Lists, queues and pickers over a library of documents, machines and conversations, and corrections to it.

Tables, by the columns that are read: documents (id, original_filename, doc_type, title, manufacturer_id, status,
review_status, deactivated_at, is_current_revision, created_at, ingested_at), manufacturers (id, name), machines (id,
manufacturer_id, model_name, family), links (document_id, machine_id, confidence, review_status), messages (id,
conversation_id, role, content, is_no_answer, created_at). Every list has a tie-break by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.ingest import eligible

# Rows that the lists show.
PICKED, RECENT, FEEDBACK, UNANSWERED = 25, 10, 100, 50


def contains(column: str, q: str) -> Column:
    """Whether q stands in the column, case aside; its own % and _ are wildcards."""
    return F.col(column).ilike(f"%{q}%")


def named(rows: DataFrame, manufacturers: DataFrame, how: str = "left") -> DataFrame:
    """rows with the column manufacturer, by manufacturer_id."""
    makers = manufacturers.select(F.col("id").alias("manufacturer_id"), F.col("name").alias("manufacturer"))
    return rows.join(makers, "manufacturer_id", how)


def list_documents(documents: DataFrame, manufacturers: DataFrame, status: str | None = None, q: str = "", include_deactivated: bool = False) -> DataFrame:
    """Documents with their maker; each filter holds only where it is given. Newest first."""
    rows = documents if include_deactivated else documents.filter("deactivated_at IS NULL")
    rows = rows.filter(F.col("status") == status) if status else rows
    rows = rows.filter(contains("original_filename", q)) if q else rows
    return named(rows, manufacturers).orderBy(F.desc("created_at"), "id")


def machine_labels(links: DataFrame, machines: DataFrame) -> DataFrame:
    """(document_id, machines, machine_ids): each document's machines by name, as 'name (0.97)'."""
    rows = links.join(machines.select(F.col("id").alias("machine_id"), "model_name"), "machine_id")
    own = F.sort_array(F.collect_list(F.struct("model_name", "machine_id", "confidence"))).alias("own")
    label = F.transform("own", lambda m: F.format_string("%s (%.2f)", m["model_name"], m["confidence"]))
    return rows.groupBy("document_id").agg(own).select("document_id", label.alias("machines"), F.col("own.machine_id").alias("machine_ids"))


def review_queue(documents: DataFrame, manufacturers: DataFrame, links: DataFrame) -> DataFrame:
    """Active documents that are not approved themselves or have a link that is not; each once, newest first."""
    open_links = links.filter("review_status <> 'approved'").select(F.col("document_id").alias("id"), F.lit(True).alias("open")).distinct()
    rows = documents.filter("deactivated_at IS NULL").join(open_links, "id", "left").filter("review_status <> 'approved' OR open")
    shown = named(rows, manufacturers)
    return shown.select("id", "original_filename", "doc_type", "manufacturer", "status", "review_status", "ingested_at").orderBy(F.desc("ingested_at"), "id")


def queue_links(links: DataFrame, machines: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """(document_id, machine_id, model_name, manufacturer, confidence, review_status, place): a document's links by status and name."""
    rows = named(links.join(machines.withColumnRenamed("id", "machine_id"), "machine_id"), manufacturers, "inner")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("review_status", "model_name", "machine_id"))
    return rows.select("document_id", "machine_id", "model_name", "manufacturer", "confidence", "review_status", place.alias("place"))


def document_counts(machines: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """machines and document_count: documents that may be retrieved and whose link is approved, 0 if there are none."""
    good = links.filter("review_status = 'approved'").select("machine_id", "document_id").distinct()
    counted = good.join(eligible(documents).select(F.col("id").alias("document_id")), "document_id").groupBy(F.col("machine_id").alias("id")).agg(F.count(F.lit(1)).alias("document_count"))
    return machines.join(counted, "id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def pick_machines(machines: DataFrame, manufacturers: DataFrame, links: DataFrame, documents: DataFrame, q: str = "", limit: int = PICKED) -> DataFrame:
    """(id, manufacturer, model_name, family, document_count) of machines that have documents, q in any of their names."""
    rows = named(document_counts(machines, links, documents), manufacturers, "inner").filter("document_count > 0")
    if q:
        rows = rows.filter(contains("model_name", q) | contains("family", q) | contains("manufacturer", q))
    return rows.select("id", "manufacturer", "model_name", "family", "document_count").orderBy("manufacturer", "model_name", "id").limit(limit)


def recent_conversations(conversations: DataFrame, limit: int = 20) -> DataFrame:
    """The conversations (conv_id, updated_at, …) that were last gone on with, newest first."""
    return conversations.orderBy(F.desc("updated_at"), "conv_id").limit(limit)


def recent_machines(recent: DataFrame, machines: DataFrame, manufacturers: DataFrame, links: DataFrame, documents: DataFrame, user_id: int, limit: int = RECENT) -> DataFrame:
    """A user's machines, favourites first, then those used last; recent: (user_id, machine_id, last_used_at, is_favorite)."""
    own = recent.filter(F.col("user_id") == user_id).select(F.col("machine_id").alias("id"), "last_used_at", "is_favorite")
    rows = named(document_counts(machines.join(own, "id"), links, documents), manufacturers, "inner")
    shown = rows.select("id", "manufacturer", "model_name", "document_count", "is_favorite", "last_used_at")
    return shown.orderBy(F.desc("is_favorite"), F.desc("last_used_at"), "id").limit(limit)


def duplicate_list(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """matches (id, kept_document_id, duplicate_document_id, match_type, similarity, detected_at) with both file names, newest first."""
    name = lambda side: documents.select(F.col("id").alias(f"{side}_document_id"), F.col("original_filename").alias(f"{side}_name"))
    return matches.join(name("kept"), "kept_document_id").join(name("duplicate"), "duplicate_document_id").orderBy(F.desc("detected_at"), "id")


def feedback_report(feedback: DataFrame, users: DataFrame, messages: DataFrame, limit: int = FEEDBACK) -> DataFrame:
    """(id, rating, created_at, user, content, conversation_id): what users said of which message, newest first."""
    said = messages.select(F.col("id").alias("message_id"), "content", "conversation_id")
    who = users.select(F.col("id").alias("user_id"), F.col("email").alias("user"))
    rows = feedback.join(said, "message_id").join(who, "user_id")
    return rows.select("id", "rating", "created_at", "user", "content", "conversation_id").orderBy(F.desc("created_at"), "id").limit(limit)


def unanswered(messages: DataFrame, limit: int = UNANSWERED) -> DataFrame:
    """(conversation_id, id, question, created_at): questions before answers that found nothing, newest first."""
    before = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    asked = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before))
    rows = asked.filter("role = 'assistant' AND is_no_answer AND question IS NOT NULL")
    return rows.select("conversation_id", "id", "question", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def own_messages(messages: DataFrame, conversations: DataFrame, user_id: int) -> DataFrame:
    """The messages of a user's conversations."""
    own = conversations.filter(F.col("user_id") == user_id).select(F.col("id").alias("conversation_id"))
    return messages.join(own, "conversation_id", "left_semi")


def saved_answers(saved: DataFrame, messages: DataFrame, user_id: int) -> DataFrame:
    """A user's saved messages, the last saved first; saved: (user_id, message_id, saved_at)."""
    own = saved.filter(F.col("user_id") == user_id).select(F.col("message_id").alias("id"), "saved_at")
    return messages.join(own, "id").orderBy(F.desc("saved_at"), "id")


def evidence(chunks: DataFrame, documents: DataFrame, administrator: bool = False) -> DataFrame:
    """(id, document_id, content, original_filename, is_current_revision): chunks that may be shown; others than administrators see approved documents only."""
    shown = documents.filter("deactivated_at IS NULL")
    shown = shown if administrator else shown.filter("review_status = 'approved'")
    names = shown.select(F.col("id").alias("document_id"), "original_filename", "is_current_revision")
    return chunks.join(names, "document_id").select("id", "document_id", "content", "original_filename", "is_current_revision")


def cited_sources(sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(message_id, place, chunk_id, document_id, original_filename): citations of each message in the order they were given.

    sources: (message_id, chunk_id, rank, is_citation, citation_ordinal); rows without an ordinal keep their rank.
    """
    of_chunk = chunks.select(F.col("id").alias("chunk_id"), "document_id")
    names = documents.select(F.col("id").alias("document_id"), "original_filename")
    rows = sources.filter("is_citation").join(of_chunk, "chunk_id").join(names, "document_id")
    place = F.row_number().over(Window.partitionBy("message_id").orderBy(F.coalesce("citation_ordinal", "rank"), "rank"))
    return rows.select("message_id", place.alias("place"), "chunk_id", "document_id", "original_filename")


def needs_first_user(users: DataFrame) -> bool:
    """Whether there is no user yet."""
    return users.limit(1).count() == 0


# --- corrections -------------------------------------------------------------------------------


def correct(documents: DataFrame, corrections: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """documents with the values of corrections (id and fields; null: as it is) in place."""
    new = corrections.select("id", *[F.col(f).alias(f"new_{f}") for f in fields])
    rows = documents.join(new, "id", "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in fields})
    return rows.select(*documents.columns)


def override_rows(documents: DataFrame, corrections: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(document_id, field, previous_value, corrected_value, corrected_by, reason): a row for each value that a correction gives."""
    old = documents.select("id", *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    rows = corrections.join(old, "id")
    given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("previous_value"), F.col(f).cast("string").alias("corrected_value"))) for f in fields]))
    return rows.select(F.col("id").alias("document_id"), "corrected_by", "reason", F.explode(given).alias("g")).select("document_id", "g.*", "corrected_by", "reason")


def replace_links(links: DataFrame, corrected: DataFrame) -> DataFrame:
    """links with those of the corrected documents replaced; corrected: (document_id, machine_ids). New ones count as reviewed."""
    stay = links.join(corrected.select("document_id").distinct(), "document_id", "left_anti")
    new = corrected.select("document_id", F.explode(F.array_distinct("machine_ids")).alias("machine_id"), F.lit(1.0).alias("confidence"), F.lit("approved").alias("review_status"))
    return stay.unionByName(new, allowMissingColumns=True)


def audit_rows(reviewed: DataFrame, actor: str) -> DataFrame:
    """(event, actor, target_id, detail) of reviewed (id, decision, note)."""
    detail = F.concat("decision", F.coalesce(F.concat(F.lit(": "), "note"), F.lit("")))
    return reviewed.select(F.lit("document_reviewed").alias("event"), F.lit(actor).alias("actor"), F.col("id").alias("target_id"), detail.alias("detail"))


def reindex(documents: DataFrame, links: DataFrame, machines: DataFrame, matches: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What new matches change: (id, old_names, new_names) of the changed documents, and all links after it.

    matches: (document_id, machine_id, model_name, confidence), those that are linked. Documents whose links a person
    has set (overrides: document_id, field = 'machine_links') stay, and so do links of confidence 1.
    """
    manual = overrides.filter("field = 'machine_links'").select(F.col("document_id").alias("id")).distinct()
    scanned = documents.filter("status IN ('indexed', 'partial') AND deactivated_at IS NULL").join(manual, "id", "left_anti").select("id")
    guessed = links.filter("confidence < 1").join(machines.select(F.col("id").alias("machine_id"), "model_name"), "machine_id")
    listed = lambda rows, name: rows.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list("model_name")).alias(name))
    none = F.array().cast("array<string>")
    both = scanned.join(listed(guessed, "old_names"), "id", "left").join(listed(matches, "new_names"), "id", "left")
    changed = both.select("id", F.coalesce("old_names", none).alias("old_names"), F.coalesce("new_names", none).alias("new_names")).filter("old_names <> new_names")
    moved = changed.select(F.col("id").alias("document_id"))
    stay = links.join(moved, "document_id", "left_anti").unionByName(links.filter("confidence >= 1").join(moved, "document_id", "left_semi"))
    new = matches.join(moved, "document_id", "left_semi").join(stay.select("document_id", "machine_id"), ["document_id", "machine_id"], "left_anti")
    return changed, stay.unionByName(new.select("document_id", "machine_id", "confidence", F.lit("pending").alias("review_status")), allowMissingColumns=True)
