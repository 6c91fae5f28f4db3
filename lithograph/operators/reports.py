"""Relational reports: pickers, queues, histories, counts and the evaluation summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


STRETCH = 1000  #: turns of a conversation that one task orders


def linked_counts(left: DataFrame, links: DataFrame, on: str, link_id: str, wanted, linked: DataFrame, linked_id: str, linked_wanted, minimum: int = 1) -> DataFrame:
    """left's columns and the number of distinct linked rows, `minimum` at least.

    The filters stand with their tables before the joins, as ON conditions of left joins do.
    """
    good = links.filter(wanted).select(on, link_id).distinct()
    ok = good.join(linked.filter(linked_wanted).select(F.col(linked_id).alias(link_id)), link_id)
    counts = ok.groupBy(on).agg(F.count_distinct(link_id).alias("linked"))
    return left.join(counts, on, "left").withColumn("linked", F.coalesce("linked", F.lit(0))).filter(F.col("linked") >= minimum)


def previous_user_turn(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, question): for each assistant turn the user's last text before it.

    A conversation is cut into stretches of STRETCH turns, so that no task holds a long one; what a stretch does not
    find it takes from the last stretch before it that has a user's text.
    """
    parts = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    before = Window.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    own = parts.withColumn("asked", asked).filter("role = 'assistant'").select("conv_id", "turn", "stretch", "asked")
    ends = parts.groupBy("conv_id", "stretch").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "stretch", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    return own.join(carried, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("asked", "carried").alias("question"))


def ordered_distinct(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value, place): each value of a key once, numbered by its first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(key, value, F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("place"))


def citation_order(rows: DataFrame, key: str) -> DataFrame:
    """rows and place: by coalesce(ordinal, rank), then rank, within the key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("ordinal", "rank"), "rank")))


def rate_breaches(events: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """(user_id, window_start, n): users with `limit` or more events in a window; also for streams with a watermark."""
    counted = events.groupBy("user_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= limit).select("user_id", F.col("window.start").alias("window_start"), "n")


def status_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def case_results(cases: DataFrame, answers: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """(id, hit, support, isolated, ok): how each case went; null where it has no such expectation.

    cases: (id, machine, expected_filename_contains, expected_keywords array, must_not_come_from array,
    expect_no_answer, expect_clarifying_question); answers: (id, filenames array, content, is_no_answer,
    is_clarifying_question); columns that are missing count as null. A case that expects a clarifying question or no
    answer is judged by that alone; one whose machine (machines: model_name) is unknown, or without an answer, fails.
    """
    known = {"cases": cases, "answers": answers}
    for table, name, kind in (("cases", "expect_clarifying_question", "boolean"), ("cases", "machine", "string"), ("answers", "is_clarifying_question", "boolean")):
        if name not in known[table].columns:
            known[table] = known[table].withColumn(name, F.lit(None).cast(kind))
    a = known["cases"].join(known["answers"].withColumn("answered", F.lit(True)), "id", "left")
    if machines is not None:
        a = a.join(machines.select(F.col("model_name").alias("machine"), F.lit(True).alias("known")).distinct(), "machine", "left")
    else:
        a = a.withColumn("known", F.lit(True))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    files = F.transform(texts("filenames"), F.lower)
    hit = F.exists(files, lambda f: f.contains(F.lower("expected_filename_contains")))
    held = F.forall("expected_keywords", lambda k: F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lower(k)))
    leaked = F.exists(files, lambda f: F.exists("must_not_come_from", lambda m: F.contains(f, F.lower(m))))
    asks, silent = F.coalesce("expect_clarifying_question", F.lit(False)), F.coalesce("expect_no_answer", F.lit(False))
    plain = ~asks & ~silent
    rows = a.select(
        "id", asks.alias("asks"), silent.alias("silent"), "answered", (F.col("machine").isNull() | F.coalesce("known", F.lit(False))).alias("resolved"),
        F.coalesce("is_clarifying_question", F.lit(False)).alias("asked"), F.coalesce("is_no_answer", F.lit(False)).alias("none"),
        F.when(plain & F.col("expected_filename_contains").isNotNull(), hit).alias("hit"),
        F.when(plain & (F.size(texts("expected_keywords")) > 0), held).alias("support"),
        F.when(plain & (F.size(texts("must_not_come_from")) > 0), ~leaked).alias("isolated"),
    )
    met = F.when(F.col("asks"), F.col("asked")).when(F.col("silent"), F.col("none")).otherwise(F.forall(F.array("hit", "support", "isolated"), lambda x: F.coalesce(x, F.lit(True))))
    return rows.select("id", "asks", "silent", "hit", "support", "isolated", (F.coalesce("answered", F.lit(False)) & F.col("resolved") & met).alias("ok"))


def evaluate(cases: DataFrame, answers: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """One row: cases, passed, hit_rate, support_rate, isolation_rate, no_answer_rate, clarify_rate.

    See case_results. Rates are taken over the cases that have the expectation, and null where none has.
    """

    def rate(ok, asked):
        return F.sum((asked & ok).cast("int")) / F.nullif(F.sum(asked.cast("int")), F.lit(0))

    c = F.col
    return case_results(cases, answers, machines).agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.sum(c("ok").cast("int")), F.lit(0)).alias("passed"),
        *[rate(c(x), c(x).isNotNull()).alias(name) for x, name in (("hit", "hit_rate"), ("support", "support_rate"), ("isolated", "isolation_rate"))],
        rate(c("ok"), c("silent")).alias("no_answer_rate"),
        rate(c("ok"), c("asks")).alias("clarify_rate"),
    )


def name_variants(rows: DataFrame, key: str, name: str, separator: str = "[/,]") -> DataFrame:
    """(key, variant): the whole name and its parts of two or more characters, each once."""
    parts = F.filter(F.transform(F.split(name, separator), F.trim), lambda p: F.length(p) >= 2)
    return rows.select(key, F.explode(F.array_distinct(F.concat(F.array(F.col(name)), parts))).alias("variant"))


def mentions(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, name): names, a bounded list, that a text has as whole words, case aside."""
    text = F.lower("text")
    found = F.array_compact(F.array(*[F.when(text.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{n.lower()}\E(?![\p{{L}}\p{{N}}_])"), F.lit(n)) for n in names]))
    return docs.select("doc_id", F.explode(found).alias("name"))
