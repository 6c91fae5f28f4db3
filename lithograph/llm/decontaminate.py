"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import let, local_table, materialize, release, spread_join, spread_keys, table, unused

SHINGLE = 5  #: words of a shingle
SIMILARITY = 0.8
BITS = 128  #: of a fingerprint, kept as two longs
BLOCKS = 8  #: of 16 bits each
BLOCK_RADIUS = 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1  #: fingerprints within it agree in some block but for BLOCK_RADIUS bits
WEIGHT_STEPS = 16  #: weights are whole numbers, so that sums do not depend on their order
BROADCAST_SHINGLES = 1_000_000  #: the items' shingles are broadcast up to this number, else joined by a shuffle
BROADCAST_DOCUMENTS = 2_000_000  #: so are the keys of documents that hold one of them (16 bytes each)

NOT_WORD = "[^\\p{L}\\p{N}]+"
NO_ID = -(1 << 63)  #: stands for a null id


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD)

    def trimmed(w: Column) -> Column:  # only the first and the last can be empty
        head, tail = (F.get(w, F.lit(0)) == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, head + 1, F.greatest(F.size(w) - head - tail, F.lit(0)))

    return let(split, trimmed)


def shingles_of(words: Column, width: int) -> Column:
    """Hash of every `width` consecutive words, in order; empty when there are fewer."""

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        joint = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])
        return F.when(F.size(h) >= width, F.transform(places, joint)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (key of id and words), item_id, n (words), width (of its shingles), shingles: one row per distinct item with words."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), words_of(F.col("text")).alias("w"))
    sized = words.select("item_id", "w", F.size("w").alias("n")).filter("n > 0").distinct()
    width = F.least(F.col("n"), F.lit(SHINGLE))
    own = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        own = F.when(width == k, shingles_of(F.col("w"), k)).otherwise(own)
    return sized.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "n", width.alias("width"), own.alias("shingles"))


def _weights(items: DataFrame) -> tuple[DataFrame, int]:
    """Weight of each of the items' shingles, by inverse item frequency, and that of a shingle that no item has."""
    total = items.count()
    df = items.select("item", F.explode("shingles").alias("shingle")).distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    scale = F.log(F.lit(2.0 + total))
    weight = F.greatest(F.round(WEIGHT_STEPS * F.log((2.0 + total) / F.col("df")) / scale), F.lit(1)).cast("int")
    return df.select("shingle", weight.alias("weight")), WEIGHT_STEPS


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash (low and high: long) by keys of rows with `shingle` and `weight`: a bit is set where the weights with it outweigh those without."""
    mixed = rows.withColumns({"m0": F.xxhash64("shingle", F.lit(17)), "m1": F.xxhash64("shingle", F.lit(29))})
    bit = lambda j: F.sum(F.when(F.getbit(f"m{j // 64}", F.lit(j % 64)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{j}")
    summed = mixed.groupBy(*keys).agg(*[bit(j) for j in range(BITS)], F.sum("weight").alias("total"))

    def joint(first: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(64):
            out = out.bitwiseOR(F.when(F.col(f"b{first + j}") > 0, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, joint(0).alias("low"), joint(64).alias("high"), "total")


def _slots(low: Column, high: Column) -> Column:
    """The places of a fingerprint's blocks in the index of its length: length, block and value in one number each."""
    half = BLOCKS // 2
    value = lambda j: F.shiftrightunsigned(low if j < half else high, 16 * (j % half)).bitwiseAND(F.lit(65535))
    return F.array(*[F.col("n").cast("long") * (BLOCKS << 16) + (j << 16) + value(j) for j in range(BLOCKS)])


def _masks() -> list[int]:
    """Every difference of at most BLOCK_RADIUS bits of a block."""
    return [sum(1 << i for i in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(16), n)]


def _index(prints: DataFrame) -> DataFrame:
    """(slot, item): the multi-index, each block of an item's fingerprint with all values within BLOCK_RADIUS bits."""
    masks = local_table(prints.sparkSession, [(_masks(),)], "masks array<int>")
    rows = prints.select("item", F.explode(_slots(F.col("item_low"), F.col("item_high"))).alias("slot")).crossJoin(F.broadcast(masks))  # one row
    return rows.select("item", "slot", F.explode("masks").alias("mask")).select(F.col("slot").bitwiseXOR(F.col("mask").cast("long")).alias("slot"), "item")


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Items found in documents: doc_id, item_id, start_word, n_words, hamming, similarity; the best window of each pair.

    Words are lower-cased runs of letters and digits; shingles are five words, for shorter items all their words. An
    item of n words is compared with windows of n words, and with all words of a document that has fewer. A window that
    reaches the similarity holds shingles of the items of its length that weigh `similarity` of the lightest of them
    or more; those are found by a join on shingles and fingerprinted: SimHash of 128 bits over the weights of all
    their shingles (inverse item frequencies). A multi-index over the items' fingerprints, of 8 blocks of 16 bits with
    all values within 3 bits, finds every window whose fingerprint is within RADIUS = 31 bits of an item's of its
    length. These are compared exactly: sum of the smaller weights over sum of the larger, repeats counted, at least
    similarity. Ties go to the first window. A pair of similarity 0.8 is about 19 bits apart.

    Null texts and texts without words are in nothing and contain nothing. Null ids of either side are kept as null.
    Rows that repeat an id count as one document where their texts are equal, and are told apart otherwise, and so do
    items whose words are equal or not; the result has one row for a pair of ids. Other columns are ignored; an empty table of either side gives an empty
    result.
    """
    items = materialize(_items(benchmark), "items")
    weights, novel = _weights(items)
    weights = materialize(weights, "item-weights")
    n_shingles = weights.count()
    posting = items.select("n", "width", F.explode("shingles").alias("shingle")).distinct()
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most SHINGLE rows
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", F.xxhash64("id", "text"))
    hits = None
    small = n_shingles <= BROADCAST_SHINGLES
    for width in widths or [SHINGLE]:
        listed = own.select("id", "row", shingles_of(words_of(F.col("text")), width).alias("all"))
        at = listed.select("id", "row", F.posexplode_outer("all").alias("place", "shingle")).filter("place IS NOT NULL")
        wanted = weights.select("shingle").join(posting.filter(F.col("width") == width).select("shingle").distinct(), "shingle")
        met = at.join(F.broadcast(wanted), "shingle") if small else spread_join(at, wanted, "shingle", "id", spread_keys(at, "shingle"))
        kept = met.select("id", "row", "place", "shingle", F.lit(width).alias("width"))
        hits = kept if hits is None else hits.union(kept)
    hits = materialize(hits, "item-hits")

    # Windows whose hits could weigh enough, and all their shingles; a shorter document is one window.
    tf = items.select("item", "item_id", "n", F.explode("shingles").alias("shingle")).groupBy("item", "item_id", "n", "shingle").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    item_weighed = materialize(tf.join(F.broadcast(weights) if small else weights, "shingle").select("item", "item_id", "n", "shingle", (F.col("tf") * F.col("weight")).alias("weight")), "item-weighed")
    least = item_weighed.groupBy("item", "n").agg(F.sum("weight").alias("total")).groupBy("n").agg((F.min("total") * similarity).alias("least"))
    lengths = posting.select("shingle", "width", "n").distinct().join(weights, "shingle").join(F.broadcast(least), "n")  # a row for each length
    starts = F.sequence(F.greatest(F.col("place") - F.col("n") + F.col("width"), F.lit(0)), F.col("place"))
    held = hits.join(F.broadcast(lengths) if small else lengths, ["shingle", "width"]).select("id", "row", "width", "n", "least", "weight", F.explode(starts).alias("start"))
    reached = held.groupBy("id", "row", "width", "n", "start").agg(F.sum("weight").alias("held"), F.first("least").alias("least")).filter("held >= least - 1e-6").drop("held", "least")
    reached = materialize(reached, "item-windows")
    involved = materialize(reached.select("id", "row").distinct(), "item-documents")
    few = involved.count() <= BROADCAST_DOCUMENTS
    source = own.join(F.broadcast(involved) if few else involved, ["id", "row"], "left_semi")
    texts = materialize(source.dropDuplicates(["id", "row"]).select("id", "row", words_of(F.col("text")).alias("w")), "item-texts")
    full = None
    for width in widths or [SHINGLE]:
        listed = texts.select("id", "row", shingles_of(F.col("w"), width).alias("all"))
        windows = reached.filter(F.col("width") == width).join(listed, ["id", "row"]).filter((F.col("start") + F.col("n") - width < F.size("all")) | (F.col("start") == 0))
        words = F.least(F.col("n"), F.size("all") + width - 1).alias("words")
        cut = windows.select("id", "row", "n", "start", words, F.explode(F.slice("all", F.col("start") + 1, F.col("n") - width + 1)).alias("shingle"))
        full = cut if full is None else full.union(cut)
    window = ["id", "row", "n", "start", "words"]
    counted = full.groupBy(*window, "shingle").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    weighed = counted.join(F.broadcast(weights) if small else weights, "shingle", "left").select(*window, "shingle", (F.col("tf") * F.coalesce("weight", F.lit(novel))).alias("weight"))
    prints = materialize(_fingerprints(weighed, window), "window-fingerprints")

    item_prints = _fingerprints(item_weighed, ["item", "item_id", "n"]).withColumnsRenamed({"low": "item_low", "high": "item_high", "total": "item_total"})
    item_prints = materialize(item_prints, "item-fingerprints")
    index = _index(item_prints)  # 5,576 entries an item: always shuffled, as the driver would hold a broadcast one several times over
    probed = prints.select(*window, "low", "high", "total", F.explode(_slots(F.col("low"), F.col("high"))).alias("slot"))
    apart = (F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))).cast("int")
    met = spread_join(probed, index, "slot", "id", spread_keys(probed, "slot")).drop("slot").join(item_prints.drop("n"), "item")
    near = met.withColumn("hamming", apart).filter(F.col("hamming") <= RADIUS).select(*window, "total", "item", "item_id", "item_total", "hamming").distinct()
    near = materialize(near, "window-candidates")
    release(items, hits, involved, prints, item_prints)  # the result reads the others

    # The exact check: shared weight of a window and an item, from the shingles of both.
    theirs = item_weighed.select("item", "shingle", F.col("weight").alias("item_weight"))
    pairs = near.select(*window, "item", "item_id", "total", "item_total", "hamming").join(F.broadcast(theirs) if small else theirs, "item")
    both = pairs.join(weighed, [*window, "shingle"]).groupBy(*window, "item", "item_id", "total", "item_total", "hamming").agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    scored = both.withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "words", "hamming", "similarity"), F.struct("similarity", -F.col("start"), -F.col("n"), "row", "item"))
    null = F.lit(None).cast("long")
    return scored.groupBy("id", "item_id").agg(best.alias("best")).select(
        F.when(F.col("id") == NO_ID, null).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("item_id") == NO_ID, null).otherwise(F.col("item_id")).alias("item_id"),
        F.col("best.start").cast("long").alias("start_word"),
        F.col("best.words").cast("long").alias("n_words"),
        F.col("best.hamming").alias("hamming"),
        F.col("best.similarity").alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that contain no item; all columns stay as they are. Rows of one doc_id go or stay together."""
    key = unused("__found", docs)
    found = contaminations(docs, benchmark, similarity).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key)).distinct()
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(found, key, "left_anti").drop(key)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
