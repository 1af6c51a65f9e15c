"""Exact n-gram Jaccard join by vertical partitioning of a global n-gram order.

A document is the set of its distinct word n-grams. Documents with equal sets form a class
at once (copies are never paired). All n-grams stand in one global order: by how often a
fixed-size sketch says they occur in the corpus, rare ones first, then by hash. That order
is cut into fragments of equal shares of the corpus' n-grams. Classes can only be similar if they share an n-gram among their
first few in that order (the prefix), so these give the candidates. For candidates, the
overlap is counted separately in each fragment and summed per pair; the sum decides exactly.

Before any set is fetched, a pair must pass three exact bounds: on the sizes; on the
difference of the sets, which is at least the Hamming distance of the parities of their
n-grams over 512 bits; and on what their prefixes share, to which the rest of the smaller
prefix's set can only add its size.

A common n-gram may stand in many classes. First each class is compared with one other only,
the one that is the centre of most of its n-grams; classes found linked then share a
label, and the rest of the search passes over pairs with the same label and over pairs that
fail the bounds, inside the join. So what is emitted follows the number of links between
classes, not the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import checkpointed, small_batches
from helixframe.llm.components import components
from helixframe.llm.wordhash import mixed, shingle_sets

#: The sketch has 2 ** SKETCH_BITS counters, summed in parts of SKETCH_PART; 1 MB in all, whatever the corpus.
SKETCH_BITS = 18
SKETCH_PART = 4096
FRAGMENTS = 8
PARITY_LONGS = 8
#: An n-gram that more classes than this share is compared in as many tasks as it has times so many; such n-grams are broadcast up to MOST_HOT.
BUCKET, MOST_HOT = 2048, 100_000
#: Tasks know what is asked for by filters of 2 to these powers of bits; what passes by chance falls out in a join.
FILTER_BITS = (20, 27)


def _key(hashes: np.ndarray) -> int:
    """A digest of a sorted set; 64 bits stand for a set as they do for an n-gram."""
    if not len(hashes):
        return 0
    weights = mixed(hashes ^ np.uint64(0x6A09E667F3BCC909))
    both = np.bitwise_xor.reduce(weights, keepdims=True) + np.add.reduce(hashes, keepdims=True)
    return int(mixed(both).view(np.int64)[0])


def _place(hashes: np.ndarray) -> np.ndarray:
    """The sketch counter of each hash."""
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _fragments(counts: np.ndarray) -> np.ndarray:
    """The fragment of each sketch counter: the counters in the global order, cut where equal shares of all n-grams of the corpus are passed."""
    order = np.argsort(counts, kind="stable")
    passed = np.cumsum(counts[order], dtype=np.int64)
    out = np.empty(len(counts), np.int64)
    out[order] = np.minimum(FRAGMENTS - 1, np.maximum(0, passed - 1) * FRAGMENTS // max(1, int(passed[-1])))
    return out


def _digests(docs: DataFrame, size: int) -> DataFrame:
    """A row a document (doc_id, n, key), and at each task's end its part sums of the sketch (part, counts)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        empty = {"part": pa.int32(), "counts": pa.binary()}
        for batch in batches:
            counts, keys, places = [], [], []
            for hashes in shingle_sets(batch.column(1), size):
                counts.append(len(hashes))
                keys.append(_key(hashes))
                places.append(_place(hashes))
            sketch += np.bincount(np.concatenate([*places, np.zeros(0, np.int64)]), minlength=len(sketch))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), *(pa.nulls(n, t) for t in empty.values())], names=["doc_id", "n", "key", *empty])
        parts = sketch.astype("<i4").reshape(-1, SKETCH_PART)
        some = np.flatnonzero(parts.any(axis=1))
        nulls = [pa.nulls(len(some), pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["doc_id", "n", "key", *empty])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id bigint, n bigint, key bigint, part int, counts binary")


def _summed(parts: DataFrame) -> np.ndarray:
    """The whole sketch; the sums run in two steps, so that no task gets the parts of all others."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_PART, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts, "<i4")
        one = rows.head(1).copy()
        one["counts"] = [np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes()]
        return one

    salted = parts.select("part", (F.spark_partition_id() % 64).alias("salt"), "counts")
    schema = "part int, salt int, counts binary"
    once = salted.groupBy("part", "salt").applyInPandas(add, schema)
    rows = once.groupBy("part").applyInPandas(add, schema).select("part", "counts").collect()
    sketch = np.zeros(((1 << SKETCH_BITS) // SKETCH_PART, SKETCH_PART), np.int32)
    for row in rows:
        sketch[row["part"]] = np.frombuffer(row["counts"], "<i4")
    return sketch.ravel()


def _prefixes(docs: DataFrame, reps: DataFrame, size: int, num: int, den: int, sketch) -> DataFrame:
    """(key, n, prefix, b0 ...): the first n-grams in the global order and the parities, of the documents in reps.

    A class whose copies pass the filter by chance may come more than once."""
    bits = [f"b{k}" for k in range(PARITY_LONGS)]
    spotted, asked = _spotted(docs, reps)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        width = 64 * PARITY_LONGS
        for batch in batches:
            keys, sizes, heads, parity = [], [], [], []
            for hashes in shingle_sets(asked(batch).column(1), size):
                n = len(hashes)
                if not n:
                    continue
                order = np.argsort(counts[_place(hashes)], kind="stable")  # hashes come sorted
                heads.append(hashes[order[: n + (-num * n) // den + 1]])
                odd = np.bincount(((hashes >> np.uint64(5)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                keys.append(_key(hashes))
                sizes.append(n)
            offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            values = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            matrix = np.array(parity, np.int64).reshape(-1, PARITY_LONGS)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists, *(pa.array(matrix[:, k]) for k in range(PARITY_LONGS))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "prefix", *bits])

    schema = "key bigint, n bigint, prefix array<bigint>, " + ", ".join(f"{b} bigint" for b in bits)
    return spotted.mapInArrow(prefix, schema)


def _shared_grams(made: DataFrame) -> DataFrame:
    """(gram, key) for prefix n-grams that occur in more than one row of made, of which most occur in one."""
    grams = made.select(F.explode("prefix").alias("gram"))
    shared = checkpointed(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram"))
    words, bits = _filter(shared, lambda bits: F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)))
    held = made.sparkSession.sparkContext.broadcast(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            grams = lists.flatten().to_numpy()
            spot = grams & ((1 << bits) - 1)
            some = (held.value[spot >> 6] >> (spot & 63)) & 1 == 1
            keys = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(grams[some]), pa.array(keys[some])], names=["gram", "key"])

    likely = made.select("key", "prefix").mapInArrow(pick, "gram bigint, key bigint")
    return likely.join(shared, "gram").distinct()


def _bounds(num: int, den: int) -> Column:
    """What the sizes and parities of l and r allow; exact in that no similar pair fails."""
    apart = sum((F.bit_count(F.col(f"l.b{k}").bitwiseXOR(F.col(f"r.b{k}"))) for k in range(PARITY_LONGS)), F.lit(0))
    sizes = (den * F.least("l.n", "r.n") >= num * F.greatest("l.n", "r.n"))
    return sizes & (apart * (den + num) <= (den - num) * (F.col("l.n") + F.col("r.n")))


def _filter(rows: DataFrame, spot) -> tuple[np.ndarray, int]:
    """A bit set of spots, 16 bits a row within FILTER_BITS; its words, not the rows, come to the driver."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * rows.count()).bit_length()))
    one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = rows.select(spot(bits).alias("spot")).select(F.floor(F.col("spot") / 64).alias("word"), one.alias("bit"))
    held = np.zeros((1 << bits) // 64, np.int64)
    made = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # 16 bytes for each 64 bits of the filter
    held[made["word"].to_numpy()] = made["bit"].to_numpy()
    return held, bits


def _spotted(docs: DataFrame, ids: DataFrame):
    """(doc_id, text, spot) and a function that keeps of its batches the rows whose doc_id may be among ids."""
    spot = lambda bits: F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words, bits = _filter(ids.select("doc_id").where("doc_id is not null"), spot)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(2).to_numpy(zero_copy_only=False)
        return batch.filter(pa.array((held.value[at >> 6] >> (at & 63)) & 1 == 1))

    return docs.where("doc_id is not null").select("doc_id", "text", spot(bits).alias("spot")), asked


def _sets(docs: DataFrame, wanted: DataFrame, size: int, sketch) -> DataFrame:
    """(key, fragment, grams): the sets of the wanted doc_ids, cut along the global order; some others pass by chance."""
    spotted, asked = _spotted(docs, wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment_of = _fragments(sketch.value)
        for batch in batches:
            keys, fragments, grams = [], [], []
            for hashes in shingle_sets(asked(batch).column(1), size):
                if not len(hashes):
                    continue
                key, at = _key(hashes), fragment_of[_place(hashes)]
                for fragment in np.unique(at).tolist():
                    keys.append(key)
                    fragments.append(fragment)
                    grams.append(hashes[at == fragment].view(np.int64))
            offsets = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fragments, pa.int32()), lists], names=["key", "fragment", "grams"])

    return spotted.mapInArrow(cut, "key bigint, fragment int, grams array<bigint>")


def _met(spread: DataFrame, condition: Column, columns: list[Column]) -> DataFrame:
    """columns of the pairs l, r of rows of spread of one n-gram for which condition holds.

    Rows of an n-gram with at most BUCKET of them meet where they are. Those of a larger one are
    dealt over salts on one side and go to each of them on the other, so each pair meets once."""
    same = F.col("l.gram") == F.col("r.gram")
    hot = checkpointed(spread.groupBy("gram").agg(F.count("*").alias("rows_")).where(F.col("rows_") > BUCKET).select("gram", F.ceil(F.col("rows_") / BUCKET).cast("int").alias("salts")))
    many = hot.limit(MOST_HOT + 1).count()
    if not many:
        return spread.alias("l").join(spread.alias("r"), same & condition).select(*columns)
    few = F.broadcast(hot) if many <= MOST_HOT else hot
    cold = spread.join(few, "gram", "left_anti")
    sized = spread.join(few, "gram")
    one = sized.withColumn("salt", F.pmod(F.xxhash64("key", "gram"), F.col("salts")).cast("int"))
    two = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = one.alias("l").join(two.alias("r"), same & (F.col("l.salt") == F.col("r.salt")) & condition)
    return cold.alias("l").join(cold.alias("r"), same & condition).select(*columns).unionAll(dealt.select(*columns))


def _promising(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose prefixes share enough: the rest of a set, after its prefix, can add so much and no more."""
    head = lambda side: facts.select(F.col("key").alias(side), F.col("prefix").alias(f"h{side}"))
    both = pairs.join(head("a"), "a").join(head("b"), "b")
    rest = F.greatest(F.col("na") - F.size("ha"), F.col("nb") - F.size("hb"))
    most = F.size(F.array_intersect("ha", "hb")) + rest
    return both.where((num + den) * most >= num * (F.col("na") + F.col("nb"))).select(pairs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int, sketch) -> DataFrame:
    """The pairs (a, b, na, nb) of class keys whose overlaps, summed over fragments, reach the threshold."""
    pairs = checkpointed(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = checkpointed(classes.join(keys, "key", "left_semi").select(F.col("rep").alias("doc_id")))
    sets = checkpointed(_sets(docs, wanted, size, sketch))
    left = sets.select(F.col("key").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = sets.select(F.col("key").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"])
    common = F.size(F.array_intersect("ga", "gb")).alias("common")
    # a class that came twice has the same overlap twice, hence the maximum within a fragment
    each = partial.select("a", "b", "na", "nb", "fragment", common).groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
    summed = each.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def joined(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: documents link at Jaccard similarity num / den or more.

    component_id is the smallest doc_id that links reach. A null or wordless text has an empty
    set, links with nothing and is its own component; a text of fewer than words words is one
    n-gram. Repeated rows come out as often as they went in, in one component; rows that share
    an id but not a text are each reported. A row with a null id takes part by its text and
    has the component of its class. No documents, no rows. Other columns are not read."""
    small_batches(docs.sparkSession)
    digests = checkpointed(_digests(docs, words))
    rows = digests.where("part is null").select("doc_id", "n", "key")
    sketch = docs.sparkSession.sparkContext.broadcast(_summed(digests.where("part is not null").select("part", "counts")))
    classes = checkpointed(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep")))

    made = checkpointed(_prefixes(docs, classes.select(F.col("rep").alias("doc_id")), words, num, den, sketch))
    spots = checkpointed(_shared_grams(made))
    degree = spots.groupBy("key").agg(F.count("*").alias("degree"))
    facts = checkpointed(made.join(degree, "key").dropDuplicates(["key"]))
    plain = facts.drop("prefix")
    allowed = _bounds(num, den)
    pair = [F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")]
    size_of = lambda one, two: F.when(F.col("l.key") < F.col("r.key"), F.col(f"{one}.n")).otherwise(F.col(f"{two}.n"))
    columns = [*pair, size_of("l", "r").alias("na"), size_of("r", "l").alias("nb")]

    ranked = spots.join(facts.select("key", "degree"), "key")
    centres = ranked.groupBy("gram").agg(F.max(F.struct("degree", "key"))["key"].alias("centre"))
    often = spots.join(centres, "gram").where("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("times"))
    near = often.groupBy("key").agg(F.max(F.struct("times", "centre"))["centre"].alias("centre"))
    near = near.join(plain.alias("l"), F.col("l.key") == near["key"]).join(plain.alias("r"), F.col("r.key") == F.col("centre"))
    stars = checkpointed(near.where(allowed).select(*columns).distinct())
    first = checkpointed(_verified(_promising(stars, facts, num, den), docs, classes, words, num, den, sketch))

    ends = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = facts.select("key", "degree")
    hub = ends.join(known.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.max(F.struct("degree", F.col("b").alias("key"))).alias("top"))
    own = F.struct("degree", "key")
    label = F.when(F.col("top") > own, F.col("top.key")).otherwise(F.col("key"))
    labelled = plain.join(hub, "key", "left").withColumn("label", label).drop("top", "degree")
    spread = checkpointed(spots.join(labelled, "key"))
    apart = (F.col("l.key") < F.col("r.key")) & (F.col("l.label") != F.col("r.label")) & allowed
    others = _met(spread, apart, columns).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    beyond = lambda n: F.ceil(num * F.col(n) / den) - 1  # noqa: E731  a set's size without its prefix
    enough = (num + den) * (F.col("shared") + F.greatest(beyond("na"), beyond("nb"))) >= num * (F.col("na") + F.col("nb"))
    rest = others.where(enough).drop("shared").join(stars, ["a", "b"], "left_anti")
    links = first.union(_verified(rest, docs, classes, words, num, den, sketch))

    name = lambda side: classes.select(F.col("key").alias(side), F.col("rep").alias(f"{side}_id"))
    named = links.join(name("a"), "a").join(name("b"), "b").where("a_id is not null and b_id is not null")
    roots = components(named.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    reached = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    full = rows.where("n > 0").join(reached, "key")
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest doc_id, and rows without an id."""
    kept = joined(docs, words, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
