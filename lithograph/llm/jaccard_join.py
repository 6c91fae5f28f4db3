"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists, and the components of its links."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import Words, block, local_table, materialize, powered, ranges_hash, release, slices, small_batches, spread_join, spread_keys, sums, table
from lithograph.llm.near_dedup import _components as components

SHINGLE = 5
SIMILARITY = (80, 100)  #: shared * 100 >= union * 80
COUNT_BITS = 21  #: log2 of the hashed shingle counts, of which only the order of shingles depends
COUNT_CHUNK = 1 << 14
SEARCH = 400  #: sets of a group that is searched, about
PAIRED = 32  #: buckets up to this size are compared pair by pair, larger ones in blocks
BLOCK = 2000  #: sets of a block whose sketches are compared, about
LONG_LISTS = 0.01  #: DivideSkip's constant: how many of the longest lists are probed instead of merged
BROADCAST_ROWS = 1_000_000  #: what names sets (50 bytes a row) is broadcast up to this number, so that texts and sets stay where they are
NO_ID = -(1 << 63)


# --- sets of shingles ----------------------------------------------------------------------------


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes: A-Z lower-cased, words between ASCII white space.

    A text of one to four words has one shingle of them all, one without words none.
    """
    raw, offsets = block(texts)
    words = Words(np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8), offsets)
    hashes, n = words.hashes(), np.diff(words.bounds)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = sums(made.astype(np.uint64)).astype(np.int64)
    start = np.arange(ends[-1]) - np.repeat(ends[:-1] - words.bounds[:-1], made)
    found = ranges_hash(powered(hashes), start, start + np.repeat(np.minimum(n, SHINGLE), made))
    return [np.unique(found[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def least_overlap(n: int | np.ndarray) -> int | np.ndarray:
    """What a set of n must share with any set that it links with: ceil of SIMILARITY of n."""
    return -(-n * SIMILARITY[0] // SIMILARITY[1])


def _at(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many rows of docs (text) have a shingle of each hash bucket, over all rows; of fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        for batch in batches:
            for texts in slices(batch.column("text").to_pylist()):
                counts += np.bincount(_at(np.concatenate([np.empty(0, np.uint64), *shingle_sets(texts)])), minlength=1 << COUNT_BITS).astype(np.uint32)
        for chunk in range(len(counts) // COUNT_CHUNK):
            own = counts[chunk * COUNT_CHUNK : (chunk + 1) * COUNT_CHUNK]
            if own.any():
                kind = np.min_scalar_type(int(own.max())).newbyteorder("<")
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([own.astype(kind).tobytes()], pa.binary())})

    def add(own: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_CHUNK, dtype="<u8")
        for counts in own.column("counts").to_pylist():
            total += np.frombuffer(counts, f"<u{len(counts) // COUNT_CHUNK}").astype("<u8")
        return pa.table({"chunk": pa.array([own.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint64)
    for row in docs.select("text").mapInArrow(partial, schema).groupBy("chunk").applyInArrow(add, schema).collect():  # 128 rows of fixed size
        out[row["chunk"] * COUNT_CHUNK : (row["chunk"] + 1) * COUNT_CHUNK] = np.frombuffer(row["counts"], "<u8")
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _digest(shingles: Column) -> Column:
    """16 bytes of the digest of a set."""
    return F.unhex(F.substring(F.sha2(shingles, 256), 1, 32))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """For each of a power of two of bins, at least as many as shingles, whether it has an odd number of them; a bin is a hash's low bits."""
    bins = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_apart(n: np.ndarray) -> np.ndarray:
    """How many shingles at most only one of two sets that link has, n being the sum of their sizes."""
    return n + 2 * (-n * SIMILARITY[0] // sum(SIMILARITY))


def _by_length(sketches: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places of the sketches of each length in words, and those sketches, a row for each."""
    found = sketches.to_pylist()
    words = np.array([len(x) // 8 for x in found], dtype=np.int64)
    own = {k: np.flatnonzero(words == k) for k in np.unique(words).tolist()}
    return {k: (at, np.frombuffer(b"".join([found[i] for i in at.tolist()]), "<u8").reshape(len(at), k)) for k, at in own.items()}


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The sketches over fewer bins: both halves together, as often as needed."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bins sketches differ, never more than shingles that only one set has; a and b are broadcast against each other, words last."""
    words = min(a.shape[-1], b.shape[-1])
    a, b = (_folded(x.reshape(-1, x.shape[-1]), words).reshape(*x.shape[:-1], words) for x in (a, b))
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), dtype=np.int32)
    for w in range(words):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def _alike(pairs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """Those pairs (asks, other, and more) whose sketches allow a link, with `apart`, in how many bins they differ, and `most`, how many a link allows.

    marks: (vertex, n, sketch). A set of many pairs is spread.
    """
    kept = [c for c in pairs.columns if c not in ("asks", "other")]
    for side, by in (("asks", "other"), ("other", "asks")):
        own = marks.select(F.col("vertex").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))
        pairs = spread_join(pairs, own, side, by, spread_keys(pairs.select(side), side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("asks_n"), dtype=np.int64) + np.asarray(batch.column("other_n"), dtype=np.int64)
            apart = np.zeros(len(n), dtype=np.int64)
            one, two = _by_length(batch.column("asks_sketch")), _by_length(batch.column("other_sketch"))
            for at, a in one.values():
                for there, b in two.values():
                    both, i, j = np.intersect1d(at, there, assume_unique=True, return_indices=True)
                    apart[both] = _apart(a[i], b[j])
            keep = pa.array(apart <= most_apart(n))
            columns = [batch.column(c) for c in ("asks", "other", *kept)] + [pa.array(apart), pa.array(most_apart(n))]
            yield pa.RecordBatch.from_arrays(columns, names=["asks", "other", *kept, "apart", "most"]).filter(keep)

    kinds = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in kept)
    return materialize(pairs.mapInArrow(run, f"asks long, other long{kinds}, apart long, most long"), name)


def _block_pairs(group: pa.Table) -> pa.Table:
    """(asks, other): pairs of sets of a block that may link by their sketches and first agree in its bucket, of different components."""
    column = lambda c: np.asarray(group.column(c).combine_chunks())
    vertex, root, n, place, asks = (column(c) for c in ("vertex", "root", "n", "place", "asks"))
    prev, none = np.asarray(group.column("prev").fill_null(0).combine_chunks()), np.asarray(group.column("prev").is_null().combine_chunks())
    a, b = [], []
    lengths = _by_length(group.column("sketch"))
    for words, (at, own) in lengths.items():
        asking = np.flatnonzero(asks[at])
        for others, (there, listed) in lengths.items():
            if max(words, others) > 2 * min(words, others):  # sizes that do not link
                continue
            for k in range(0, len(asking), max(1, (1 << 20) // len(there))):
                mine = asking[k : k + max(1, (1 << 20) // len(there))]
                i, j = np.nonzero(_apart(own[mine][:, None], listed[None]) <= most_apart(n[at[mine]][:, None] + n[there][None]))
                i, j = at[mine][i], there[j]
                most = 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1  # as in _may_link
                keep = (root[i] != root[j]) & ((prev[i] != prev[j]) | none[i] | none[j]) & (most * sum(SIMILARITY) >= SIMILARITY[0] * (n[i] + n[j]))
                a.append(vertex[i[keep]])
                b.append(vertex[j[keep]])
    joined = lambda x: pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64())
    return pa.table({"asks": joined(a), "other": joined(b)})


def _signed(docs: DataFrame, counts) -> DataFrame:
    """id, key (of the set, null without shingles), n, prefix: the rarest n - least_overlap(n) + 1 shingles, rarest first, and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("id"), 0
            for texts in slices(batch.column("text").to_pylist()):
                sets = shingle_sets(texts)
                prefixes = []
                for own in sets:
                    order = np.lexsort((own, counts.value[_at(own)]))
                    prefixes.append(own[order[: len(own) - least_overlap(len(own)) + 1]].view(np.int64) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)),
                        pa.array([s.astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "own", "prefix", "sketch"],
                )
                at += len(texts)

    made = docs.mapInArrow(run, "id long, own binary, prefix array<long>, sketch binary")
    return made.select("id", _digest(F.col("own")).alias("key"), F.coalesce(F.length("own") / 8, F.lit(0)).cast("long").alias("n"), "prefix", "sketch")


# --- T-occurrence search -------------------------------------------------------------------------


def t_occurrence(postings: list[int], lists: list[tuple[int, int]], least: int, skip: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
    """(member, how many lists have it) of all members, but for those of the range `skip`, that at least `least` of the lists have.

    postings: sorted members of all lists, one list after the other; lists: where those asked for begin and end.
    DivideSkip: the longest lists are set apart. The short ones are merged by a heap of their heads; where fewer heads
    agree than the short lists must give, so many are taken off that the next head is the first that can still reach
    it, and their lists skip to it. What is found is looked up in the long lists by binary search, as long as it can
    still reach `least`.
    """
    if least < 1 or len(lists) < least:
        return []
    low, high = skip
    if low < high:  # lists of which nothing else is left do not count
        lists = [(a, b) for a, b in lists if postings[a] < low or postings[b - 1] >= high]
        if len(lists) < least:
            return []
    lists = sorted(lists, key=lambda x: x[1] - x[0])
    longest = lists[-1][1] - lists[-1][0]
    apart = min(least - 1, int(least / (LONG_LISTS * log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - apart], lists[len(lists) - apart :]
    needed = least - apart
    place = [a for a, _ in short]
    heads = [(postings[a], k) for k, (a, _) in enumerate(short)]
    heapq.heapify(heads)
    out = []
    while len(heads) >= needed:
        member, popped = heads[0][0], []
        if low <= member < high:  # all lists go on behind the range at once
            popped = [k for _, k in heads]
            heads, goal = [], high
            for k in popped:
                place[k] = bisect_left(postings, goal, place[k], short[k][1])
                if place[k] < short[k][1]:
                    heads.append((postings[place[k]], k))
            heapq.heapify(heads)
            continue
        while heads and heads[0][0] == member:
            popped.append(heapq.heappop(heads)[1])
        if len(popped) >= needed:
            count, left = len(popped), len(long_)
            for a, b in long_:
                if count + left < least:
                    break
                at = bisect_left(postings, member, a, b)
                count += at < b and postings[at] == member
                left -= 1
            if count >= least:
                out.append((member, count))
            goal = member + 1
        else:
            while heads and len(popped) < needed - 1:
                popped.append(heapq.heappop(heads)[1])
            if not heads:
                break
            goal = heads[0][0]  # fewer than needed lists have a head before it
        for k in popped:
            place[k] = bisect_left(postings, goal, place[k], short[k][1])
            if place[k] < short[k][1]:
                heapq.heappush(heads, (postings[place[k]], k))
    return out


def _links(group: pa.Table) -> pa.Table:
    """(a, b): links of the sets of a group that ask with its other sets, those of their own component (root) aside; inverted lists are made of the group's sets."""
    group = group.sort_by([("root", "ascending"), ("vertex", "ascending")])  # a component is a range of members
    vertex, root = group.column("vertex").to_pylist(), np.asarray(group.column("root").combine_chunks(), dtype=np.int64)
    sets = [np.frombuffer(s, "<u8") for s in group.column("own").to_pylist()]
    asks = group.column("asks").to_pylist()
    low, high = np.searchsorted(root, root, "left").tolist(), np.searchsorted(root, root, "right").tolist()
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((owner, every))
    distinct, begin = np.unique(every[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    postings = owner[order].tolist()
    a, b = [], []
    for i in np.flatnonzero(np.array(asks)).tolist():
        mine = np.searchsorted(distinct, sets[i])
        mine = mine[ends[mine] - begin[mine] > 1]  # others have no member but the one that asks
        for j, shared in t_occurrence(postings, list(zip(begin[mine].tolist(), ends[mine].tolist(), strict=True)), int(least_overlap(len(sets[i]))), (low[i], high[i])):
            if shared * SIMILARITY[1] >= SIMILARITY[0] * (len(sets[i]) + len(sets[j]) - shared):
                a.append(vertex[i])
                b.append(vertex[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _searched(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the links of pairs (asks, other) and of what is searched with them; a set is sent once to each group that it is in."""
    wanted = materialize(pairs.select("asks").union(pairs.select("other")).distinct().withColumnRenamed("asks", "vertex").join(nodes, "vertex"), "join-wanted")
    sets = materialize(_sets(docs, wanted), "join-sets")
    if sets.count() > wanted.count():
        again, sets = sets, materialize(sets.dropDuplicates(["vertex"]), "join-sets")
        release(again)
    groups = _pair_groups(pairs)
    if groups.count() <= BROADCAST_ROWS:
        held = sets.join(F.broadcast(groups), "vertex")
    else:
        held = spread_join(groups, sets, "vertex", "cell", spread_keys(groups, "vertex"))
    links = materialize(held.select("cell", "vertex", "root", "asks", "own").groupBy("cell").applyInArrow(_links, "a long, b long").distinct(), "join-links")
    release(wanted, sets)
    return links


def _pair_groups(pairs: DataFrame) -> DataFrame:
    """Groups of about SEARCH sets for pairs (asks, other): pairs of one that asks are together, those of many others in parts."""
    n = max(1, pairs.count() // SEARCH)
    sizes = pairs.groupBy("asks").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SEARCH).select("asks", F.ceil(F.col("n") / SEARCH).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "asks", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("other"), "parts")))
    # Those that ask for few share a group by hash; a part of a large one is a group of its own.
    cell = F.when(F.col("part").isNull(), F.pmod(F.xxhash64("asks"), F.lit(n))).otherwise(F.xxhash64("asks", "part"))
    dealt = dealt.withColumn("cell", F.struct(F.col("part").isNull().alias("shared"), cell.alias("number")))
    both = dealt.select("cell", F.col("asks").alias("vertex"), F.lit(True).alias("asks")).union(dealt.select("cell", F.col("other").alias("vertex"), F.lit(False).alias("asks")))
    return both.groupBy("cell", "vertex").agg(F.bool_or("asks").alias("asks")).withColumn("root", F.col("vertex"))


def _may_link(n: str, place: str, other_n: str, other_place: str) -> Column:
    """Whether sets of these sizes that first agree at these places of their orders can share enough."""
    most = 1 + F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place)) - 1
    return most * (SIMILARITY[0] + SIMILARITY[1]) >= SIMILARITY[0] * (F.col(n) + F.col(other_n))


# --- the join ------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the connected components of documents whose shingle sets are alike, one row per input row.

    docs: (doc_id, text). Two documents link when 100 * shared >= 80 * union of their distinct five-word shingles.
    Documents of equal sets are one vertex. Sets that link share one of their rarest shingles (of n the first
    n - ceil(0.8 n) + 1 in one order over all), so the sets under each such shingle, a bucket, are the candidates. In
    each bucket, but for those whose sets have all met in one before, two sets ask first: the one that meets most others, and one by a hash. A set that asks is answered by
    T-occurrence search (t_occurrence) over the inverted lists of a bounded group of sets. That joins nearly all that belongs
    together; where a bucket still holds several components, all its sets outside the largest (or outside those that met in one bucket before, if these are more) ask for the others,
    pair by pair in small buckets, in blocks in larger ones. Before any set is sent to a group, sketches of its pairs are
    compared: the bins of a sketch that have an odd number of a set's shingles differ between two sets in no more bins than
    there are shingles that only one of them has, so a pair that links always passes. So no link that can join components is lost, no task holds a
    bucket, and a large group of near copies is not expanded into its pairs.

    The order of shingles is by hashed counts over all rows, which costs or saves work and changes no link. Null texts
    and texts without words have no shingle and link with nothing. Null ids count as the smallest and come back as
    null. Rows that repeat an id are documents of their own. Other columns are ignored; an empty table gives an empty
    result.
    """
    with small_batches(docs.sparkSession):  # all that runs Python ends in here
        return _jaccard_components(docs)


def _jaccard_components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(own))  # of fixed size
    # Written once: the number of a row, which stands for its set, then stays what it is.
    signed = materialize(_signed(own, counts).withColumn("row", F.monotonically_increasing_id()), "join-signed")
    nodes = signed.filter("n > 0").groupBy("key").agg(F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select("key", F.col("least.id").alias("id"), F.col("least.row").alias("vertex"), "copies"), "join-nodes")

    firsts = _firsts(signed, nodes).select("vertex", "n", F.posexplode("prefix").alias("place", "shingle"))
    limit = max(200, (signed.agg(F.sum(F.size("prefix"))).first()[0] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets, sizes = _buckets(firsts, counts.value, limit)

    twos = buckets.filter("partner IS NOT NULL").select(F.col("partner.vertex").alias("asks"), F.col("vertex").alias("other"), F.lit(0).cast("long").alias("weight"))
    met = materialize(_before(buckets.filter("partner IS NULL").drop("partner")), "join-before")
    hot = spread_keys(met, "shingle")
    ranked = met.withColumn("order", F.struct("weight", F.xxhash64("vertex", "shingle").alias("hash"), "vertex", "n", "place"))
    leaders = ranked.groupBy("shingle").agg(
        F.max("order").alias("low"), F.max_by("order", F.col("order.hash")).alias("high"), F.min("prev").alias("a"), F.max("prev").alias("b"), F.count("prev").alias("c"), F.count(F.lit(1)).alias("all")
    )
    leaders = leaders.filter(~((F.col("c") == F.col("all")) & (F.col("a") == F.col("b")))).select("shingle", "low", "high")
    active = materialize(spread_join(met.drop("weight"), leaders, "shingle", "vertex", hot), "join-buckets")

    star = lambda side: active.select(
        F.col(f"{side}.vertex").alias("asks"), F.col(f"{side}.n").alias("an"), F.col(f"{side}.place").alias("ap"), F.col("vertex").alias("other"), "n", "place", F.col(f"{side}.weight").alias("weight")
    )
    stars = star("low").union(star("high")).filter("asks <> other").filter(_may_link("an", "ap", "n", "place"))
    stars = materialize(stars.select("asks", "other", "weight").union(twos).groupBy("asks", "other").agg(F.max("weight").alias("weight")), "join-stars")
    release(met, *sizes)  # twos and met were read from these
    marked = active.select("vertex").union(stars.select("asks")).union(stars.select("other")).distinct()
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    marks = materialize(signed.select(F.col("row").alias("vertex"), "n", "sketch").join(marked, "vertex"), "join-marks")
    pairs = _alike(stars, marks, "join-pairs")
    # Each set is searched with one of those that ask for it; who is surely alike comes first, then who meets most others.
    sure = F.col("apart") * 2 <= F.col("most")
    chosen = pairs.groupBy("other").agg(F.max_by("asks", F.struct(sure, F.when(sure, F.col("weight")), -F.col("apart"), "asks")).alias("asks"))
    links = _searched(own, nodes, materialize(chosen, "join-chosen"))
    named = nodes.select(F.col("vertex").alias("key"), "id")
    roots = materialize(components(named, links).select(F.col("key").alias("vertex"), F.col("root")), "join-roots")
    between = _between(active, pairs, roots, marks, hot)
    if between.limit(1).count():
        links = links.unionByName(_searched(own, nodes, between))
    release(active, stars, marks, pairs, between)
    classes = components(named, links).select(F.col("key").alias("vertex"), F.col("class_id").alias("component"))
    grouped = nodes.join(classes, "vertex", "left").select("key", F.coalesce("component", "id").alias("component"))
    rows = signed.select("id", "n", "key")
    rows = rows.filter("n = 0").withColumn("component", F.col("id")).unionByName(spread_join(rows.filter("n > 0"), grouped, "key", "id", spread_keys(rows, "key")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def _firsts(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The row of each set that stands for it, as `vertex`; only sets of several rows are looked up, so that prefixes stay where they are."""
    several = nodes.filter("copies > 1").select("key", "vertex")
    rows = signed.filter("n > 0").select("key", "row", "n", "prefix")
    if several.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(several), "key", "left").filter("vertex IS NULL OR vertex = row").drop("vertex").withColumnRenamed("row", "vertex")
    return rows.join(nodes.select(F.col("vertex").alias("row")), "row").withColumnRenamed("row", "vertex")


def _buckets(firsts: DataFrame, counts: np.ndarray, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """firsts (shingle, vertex, n, place) with `size`, how many have the shingle, where several have; and the tables written for it.

    Of two alone that have a shingle one row is kept, with the other as `partner`, and none where they cannot link.

    One shuffle: rows are dealt by shingle, but where the hashed counts, never below the true ones, show that a shingle may have
    more than limit rows, by a part of the vertices too. Only the rows of these are counted once more.
    """
    spark = firsts.sparkSession
    many = [(int(k), int(-(-int(counts[k]) // limit))) for k in np.flatnonzero(counts > limit)]  # bounded by the number of partitions
    listed = F.broadcast(local_table(spark, many, "slot int, parts int"))
    dealt = firsts.withColumn("slot", F.shiftrightunsigned("shingle", 64 - COUNT_BITS).cast("int")).join(listed, "slot", "left").drop("slot")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vertex"), F.coalesce("parts", F.lit(1))).cast("int")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shingle", "part")
    together = Window.partitionBy("shingle", "part")
    counted = dealt.withColumns({"size": F.count(F.lit(1)).over(together), "first": F.min(F.struct("vertex", "n", "place")).over(together)})
    two = F.col("parts").isNull() & (F.col("size") == 2)
    counted = counted.filter("size > 1 OR parts IS NOT NULL").withColumns({"partner": F.when(two, F.col("first")), "an": F.col("first.n"), "ap": F.col("first.place")})
    counted = counted.filter(~two | ((F.col("vertex") != F.col("first.vertex")) & _may_link("an", "ap", "n", "place")))
    met = materialize(counted.drop("part", "first", "an", "ap"), "join-met")
    if not many:
        return met.drop("parts"), [met]
    split = met.filter("parts IS NOT NULL").drop("parts", "size")
    sizes = materialize(split.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "join-sizes")
    hot = [(r["shingle"], -(-r["size"] // limit)) for r in sizes.filter(F.col("size") > limit).collect()]  # bounded by the number of partitions
    return met.filter("parts IS NULL").drop("parts").unionByName(spread_join(split, sizes, "shingle", "vertex", hot)), [met, sizes]


def _before(met: DataFrame) -> DataFrame:
    """met with `prev`, the shingle of a bucket that the set has next before this one, and `weight`, how many sets it meets.

    Sets that have the same prev in a bucket have met in that one before: where two sets first agree, they never have. So a
    bucket all of whose sets have one prev adds nothing, and in others only pairs of different prev, or of none, need a search.
    """
    of_set = Window.partitionBy("vertex")  # as many rows as a document has rare shingles
    return met.withColumns({"weight": F.sum("size").over(of_set), "prev": F.lag("shingle").over(of_set.orderBy("place"))})


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, own): the sets of wanted (vertex, key, id), made again from the texts; more than once where rows repeat id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text").to_pylist()):
                made = [s.astype("<u8").tobytes() for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("vertex").slice(at, len(texts)), batch.column("key").slice(at, len(texts)), pa.array(made, pa.binary())], names=["vertex", "key", "own"])
                at += len(texts)

    # Rows that repeat the id have other texts perhaps, and other keys then.
    named = wanted.select("vertex", "key", "id")
    made = docs.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "id").select("vertex", "key", "text").mapInArrow(run, "vertex long, key binary, own binary")
    return made.filter(_digest(F.col("own")) == F.col("key")).select("vertex", "own")


def _between(active: DataFrame, pairs: DataFrame, roots: DataFrame, marks: DataFrame, hot: list[tuple]) -> DataFrame:
    """Pairs (asks, other) between different components that may link by their sketches: those of pairs, and all that first meet in a bucket.

    Of a bucket the sets of its largest component, or those of its most frequent prev where they are more, do not ask.
    """
    rooted = lambda c, name: roots.select(F.col("vertex").alias(c), F.col("root").alias(name))
    left = pairs.select("asks", "other").join(rooted("asks", "asks_root"), "asks", "left")
    left = left.join(rooted("other", "other_root"), "other", "left")
    left = left.filter("coalesce(asks_root, asks) <> coalesce(other_root, other)").select("asks", "other")
    rows = active.filter("size > 2").select("shingle", "vertex", "n", "place", "prev").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    kinds = F.array(*[F.struct(F.lit(c == "prev").alias("by_prev"), F.col(c).alias("value")) for c in ("root", "prev")])
    shares = rows.select("shingle", F.inline(kinds)).filter("value IS NOT NULL").groupBy("shingle", "by_prev", "value").agg(F.count(F.lit(1)).alias("m"))
    many = shares.groupBy("shingle").agg(
        F.max_by(F.struct("by_prev", "value"), F.struct("m", "by_prev", "value")).alias("idle"),
        F.sum(F.when(~F.col("by_prev"), F.col("m"))).alias("size"),
        F.max("m").alias("most"),
        F.count_if(~F.col("by_prev")).alias("parts"),
    )
    mixed = spread_join(rows, many.filter("parts > 1 AND most < size").drop("parts"), "shingle", "vertex", hot)
    idle = F.when(F.col("idle.by_prev"), F.col("prev").eqNullSafe(F.col("idle.value"))).otherwise(F.col("root") == F.col("idle.value"))
    mixed = materialize(mixed.withColumn("asks", ~idle).drop("idle"), "join-mixed")
    small = mixed.filter(F.col("size") <= PAIRED)
    asking = small.filter("asks").select("shingle", F.col("vertex").alias("asks"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("root").alias("own_root"), F.col("prev").alias("own_prev"))
    few = asking.join(small.select("shingle", F.col("vertex").alias("other"), "n", "place", "root", "prev"), "shingle")
    few = few.filter("own_root <> root AND coalesce(own_prev <> prev, true)").filter(_may_link("an", "ap", "n", "place"))
    few = materialize(few.select("asks", "other").distinct(), "join-few")
    found = _alike(few, marks, "join-few")
    large = mixed.filter(F.col("size") > PAIRED)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    counted = large.withColumn("rest", F.col("size") - F.col("most")).withColumn("listed", blocks("size")).withColumn("asking", blocks("rest")).join(marks.drop("n"), "vertex")
    place = lambda n: F.pmod(F.xxhash64("vertex", "shingle"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = ["shingle", "vertex", "root", "prev", "n", "place", "sketch"]
    # One that asks is listed too, but where its block asks of its own, as one row.
    member = counted.select(*told, each("asking").alias("i"), place(F.col("listed")).alias("j"), F.when(F.col("asks"), place(F.col("asking"))).alias("at")).withColumn("asks", F.coalesce(F.col("at") == F.col("i"), F.lit(False))).drop("at")
    asker = counted.filter("asks").select(*told, place(F.col("asking")).alias("i"), each("listed").alias("j"), place(F.col("listed")).alias("at")).filter("at <> j").drop("at").withColumn("asks", F.lit(True))
    cells = member.unionByName(asker).groupBy("shingle", "i", "j").applyInArrow(_block_pairs, "asks long, other long")
    out = materialize(left.unionByName(found.select("asks", "other")).unionByName(cells).distinct(), "join-between")
    release(mixed, few, found)
    return out


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the Jaccard similarity of their shingles; see jaccard_components."""
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op13_jaccard_join": op13_jaccard_join}
ORACLES = {
    "op13_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), c AS (
  SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS rep FROM s
), u AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM c WHERE doc_id = rep
), l AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(a, b) AS (
  SELECT DISTINCT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE coalesce(component, rep) END AS component_id FROM c LEFT JOIN k USING (rep)
"""
}
