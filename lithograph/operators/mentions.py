"""Which machine a question speaks of: by its exact names, else by names that are nearly said."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lithograph.operators.patterns import with_candidates
from lithograph.sources.shared import split_join

# The least ratio that counts as a mention, and the options that are offered.
FUZZY, OPTIONS = 85, 5


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of a, all of them moved on together by each of b."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * common(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: how alike two texts are as sets of words; 100 where one's words are among the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    whole = [f"{both} {own}".strip() for own in (left, right)]
    return max([ratio(*whole), *([ratio(both, own) for own in whole] if both else [])])


@F.pandas_udf(DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def machine_names(machines: DataFrame) -> DataFrame:
    """(machine_id, label, name): a machine's model name, its parts between slashes and commas, and its aliases, lower-cased."""
    parts = F.filter(F.transform(F.split("model_name", "[/,]"), F.trim), lambda p: F.length(p) >= 2)
    whole = F.filter(F.array("model_name"), lambda p: F.length(p) >= 2)
    names = F.array_distinct(F.transform(F.concat(whole, parts, F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    return machines.select(F.col("id").alias("machine_id"), F.concat_ws(" ", "manufacturer", "model_name").alias("label"), F.explode(names).alias("name"))


# --- names that are nearly said ------------------------------------------------------------------


def _sides(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words: distinct ones, sorted; size: of these in one line): texts without words are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    return rows.select(key, words.alias("words")).filter(F.size("words") > 0).withColumn("size", F.length(F.array_join("words", " ")))


def _grams(sides: DataFrame, key: str) -> DataFrame:
    """(key, size, gram, again): pairs of neighbouring characters, a repeated one with its number."""
    line = sides.select(key, "size", F.array_join("words", " ").alias("line")).filter("size > 1")
    pairs = line.select(key, "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substring("line", i, F.lit(2)))).alias("gram"))
    counted = pairs.groupBy(key, "size", "gram").agg(F.count(F.lit(1)).alias("m"))
    return counted.select(key, "size", "gram", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("again"))


def _reach(a: str, b: str, threshold: float) -> Column:
    """Whether texts of these lengths can have the ratio: no subsequence is longer than the shorter one."""
    return 200 * F.least(a, b) >= threshold * (F.col(a) + F.col(b))


def fuzzy_pairs(asked: DataFrame, names: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(ask, named, ratio): all pairs of texts with a token_set_ratio of at least threshold; asked: (ask, text), names: (named, text).

    Pairs that share a word are found by the word. Of others all words count, so that both texts must be of nearly one
    length, and must share so many pairs of characters: of a text each of the characters that differ ends two
    at most. These are found by a join on pairs of characters within the lengths that can meet, and counted. Ratios
    are worked out for what is left alone, by bits of whole lines at once. The threshold must be above 75: below, texts
    need not share pairs of characters.
    """
    if threshold <= 75:
        raise ValueError("the threshold must be above 75")
    a, b = _sides(asked, "ask", "text"), _sides(names, "named", "text").withColumnRenamed("size", "other")
    by_word = split_join(a.select("ask", F.explode("words").alias("word")), b.select("named", F.explode("words").alias("word")), "word", "ask").select("ask", "named").distinct()
    # What both share, and what each has besides, bounds each of the three ratios by lengths alone.
    both = by_word.join(a.withColumnRenamed("words", "wa"), "ask").join(b.withColumnRenamed("words", "wb"), "named")
    shared = both.withColumn("s", F.length(F.array_join(F.array_intersect("wa", "wb"), " ")))
    shared = shared.filter(_reach("size", "other", threshold) | _reach("s", "size", threshold) | _reach("s", "other", threshold) | (F.col("s") == F.least("size", "other"))).select("ask", "named")

    limits = b.agg(F.min("other").alias("low"), F.max("other").alias("high")).first()
    if limits["low"] is None:
        return asked.select("ask").limit(0).crossJoin(names.select("named").limit(0)).withColumn("ratio", F.lit(0.0))
    part = threshold / (200 - threshold)  # of two lengths that can meet, the shorter over the longer
    near = _grams(a.filter((F.col("size") * part <= limits["high"]) & (F.col("size") >= limits["low"] * part)), "ask")
    sizes = F.sequence(F.ceil(F.col("size") * part - 1e-9).cast("int"), F.floor(F.col("size") / part + 1e-9).cast("int"))
    key = lambda size: F.struct(F.col(size).alias("size"), "gram", "again")
    left = near.withColumn("other", F.explode(sizes)).select("ask", "size", key("other").alias("key"))
    right = _grams(b.withColumnRenamed("other", "size"), "named").select("named", F.col("size").alias("other"), key("size").alias("key"))
    met = left.join(right, "key").groupBy("ask", "named", "size", "other").agg(F.count(F.lit(1)).alias("shared"))
    apart = F.floor((1 - threshold / 100) * (F.col("size") + F.col("other")) + 1e-9)
    enough = met.filter(F.col("shared") >= F.greatest("size", "other") - 1 - 2 * apart).select("ask", "named")
    # Lines so short that they may share no pair of characters at all are few lengths; they meet by a character.
    short = F.greatest("size", "other") - 1 - 2 * apart <= 0
    letters = lambda df, k, size: df.filter(F.col(size) <= 1 / (threshold / 25 - 3) + 2).select(k, size, F.explode(F.array_distinct(F.split(F.array_join("words", " "), ""))).alias("c"))
    brief = letters(a, "ask", "size").join(letters(b, "named", "other"), "c").filter(short & _reach("size", "other", threshold)).select("ask", "named")
    found = shared.union(enough).union(brief).distinct()
    scored = found.join(asked.select("ask", F.col("text").alias("ta")), "ask").join(names.select("named", F.col("text").alias("tb")), "named")
    return scored.select("ask", "named", _ratios("ta", "tb").alias("ratio")).filter(F.col("ratio") >= threshold)


def exact_mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, machine_id, label): names that stand in a question as whole words; one automaton of all names finds where to look."""
    asked = questions.select("query_id", F.lower("question").alias("q"))
    listed = names.withColumn("pattern", F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b")))
    return with_candidates(asked, ["q"], listed, "pattern").filter(F.regexp_like("q", F.col("pattern"))).select("query_id", "machine_id", "label").distinct()


def resolve(questions: DataFrame, machines: DataFrame) -> DataFrame:
    """(query_id, machine_id, options): the one machine that a question names, or up to OPTIONS labels where several are named.

    machines: (id, manufacturer, model_name, aliases array). A name that stands in the question as whole words counts;
    only questions where none does are held against names of a token_set_ratio of FUZZY or more.
    """
    names = machine_names(machines)
    exact = exact_mentions(questions, names)
    open_ = questions.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    told = names.withColumn("named", F.struct("machine_id", "name"))
    near = fuzzy_pairs(open_.select(F.col("query_id").alias("ask"), F.lower("question").alias("text")), told.select("named", F.col("name").alias("text")).distinct())
    near = near.join(told.select("named", "label").distinct(), "named").select(F.col("ask").alias("query_id"), F.col("named.machine_id").alias("machine_id"), "label").distinct()
    found = exact.unionByName(near).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("machine_id", "label"))).alias("own"))
    rows = questions.select("query_id").join(found, "query_id", "left")
    n = F.coalesce(F.size("own"), F.lit(0))
    return rows.select(
        "query_id", F.when(n == 1, F.get("own", F.lit(0))["machine_id"]).alias("machine_id"),
        F.when(n > 1, F.slice(F.col("own.label"), 1, OPTIONS)).otherwise(F.array().cast("array<string>")).alias("options"),
    )
