"""Matched control regions: same chromosome, same GC content, clear of masks and of each other."""

from __future__ import annotations

import bisect
import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.dna import gc_fraction
from helixframe.functions.keyed import keyed_start
from helixframe.operators.intervals import _cuts, merged, overlap_pairs, overlapping
from helixframe.plans.materialise import broadcast_if_small, checkpointed, row_batches

CHUNK = 1000
#: Letters a tile of a counted genome, and tiles a partition.
SPAN, TILES = 1 << 18, 128
#: So many open proposals of a chromosome are passed in order by one task, as a stream.
FEW = 50_000_000
#: More keys than this make so many attempts in the first wave, and each wave brings those without a control to so many times what the one before did; fewer make all at once.
WAVES, FIRST, GROWTH = 1000, 4, 4
#: Controls for each positive by split.
CONTRACT = {"train": 1, "test": 10}
#: Bits of a letter in either case: 1 known, 2 strong.
_CODES = bytes(3 if c in b"CGcg" else 1 if c in b"ATat" else 0 for c in range(256))


def genome_store(genome: DataFrame, name: str, buckets: int = 200) -> DataFrame:
    """genome (chrom, piece, seq) as a table of the warehouse, bucketed by chromosome and piece: regions are read from it without moving it. Fails on a piece that is there twice."""
    twice = genome.groupBy("chrom", "piece").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"a piece is there twice: {twice[0]['chrom']} {twice[0]['piece']}")
    plain = genome.select("chrom", F.col("piece").cast("bigint").alias("piece"), "seq")
    plain.repartition(buckets, "chrom", "piece").write.bucketBy(buckets, "chrom", "piece").sortBy("chrom", "piece").mode("overwrite").saveAsTable(name)
    return genome.sparkSession.table(name)


def region_sequences(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """regions (chrom, start, end) with seq, from pieces of CHUNK letters; fails on a region that leaves the genome or meets a piece twice.

    Of a genome that is counted, those that meet no shut letter, with the numbers of known and strong letters in place of seq.

    An equi-join on chromosome and piece; each piece is cut to the region's letters before it moves, and the cuts are put together in order."""
    if "planes" in genome.columns:
        return _region_counts(regions, genome)
    parts = regions.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))))
    keys = list(regions.columns)
    letters = genome.select("chrom", F.col("piece").cast("bigint").alias("piece"), F.col("seq").alias("part_"))
    low, high = F.greatest(F.col("start") - F.col("piece") * CHUNK, F.lit(0)), F.least(F.col("end") - F.col("piece") * CHUNK, F.lit(CHUNK))
    cut = parts.join(letters, ["chrom", "piece"], "left").withColumn("part_", F.upper(F.col("part_").substr((low + 1).cast("int"), (high - low).cast("int"))))
    grouped = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "part_"))).alias("parts_"))
    whole = grouped.withColumn("seq", F.array_join(F.transform(F.array_distinct("parts_"), lambda p: p["part_"]), ""))
    pieces = F.floor((F.col("end") - 1) / CHUNK) - F.floor(F.col("start") / CHUNK) + 1
    once = F.assert_true(F.size("parts_") % pieces == 0, F.lit("a piece is there twice")).isNull()
    met = F.length("seq") == F.col("end") - F.col("start")
    fine = F.assert_true(met, F.concat_ws(" ", F.lit("a region leaves the genome:"), "chrom", "start", "end")).isNull()
    return whole.where(once & fine).drop("parts_")


def _covering(regions: DataFrame) -> DataFrame:
    """Regions (chrom, start, end) that cover the same positions, at most one a start; those longer than a tile are disjoint, so that few of them meet a tile."""
    plain = checkpointed(regions.groupBy("chrom", "start").agg(F.max("end").alias("end")))
    long = F.col("end") - F.col("start") > SPAN
    return plain if not plain.where(long).take(1) else plain.where(~long).unionByName(merged(plain.where(long)).drop("n_members"))


def counted(genome: DataFrame, closed: DataFrame, allowed: DataFrame | None = None, reach: int = 0) -> DataFrame:
    """chrom, tile, planes: a genome (chrom, piece, seq) as bits, three a letter, in tiles of SPAN letters and the reach letters behind them.

    The planes of a tile follow each other: letters that are known (A, C, G, T), letters that are
    strong (G, C), and letters that are shut, as they lie in closed or, where allowed is given,
    outside it. A letter that is missing or there twice is strong and not known. Regions of up to
    reach letters find all they need in the tile where they start (region_sequences)."""
    reach += -reach % 64
    width = SPAN + reach
    low = F.col("piece").cast("bigint") * CHUNK
    letters = genome.select("chrom", low.alias("low"), (low + CHUNK).alias("high"), F.substring("seq", 1, CHUNK).cast("binary").alias("seq"), F.lit(0).alias("kind"))
    of = lambda rows, kind: rows.select("chrom", F.col("start").alias("low"), F.col("end").alias("high"), F.lit(None).cast("binary").alias("seq"), F.lit(kind).alias("kind"))
    rows = letters.unionByName(of(_covering(closed), 1))
    rows = rows if allowed is None else rows.unionByName(of(_covering(allowed), 2))
    first, last = F.greatest(F.floor((F.col("low") - reach) / SPAN), F.lit(0)), F.floor((F.col("high") - 1) / SPAN)
    tiles = rows.where(last >= first).withColumn("tile", F.explode(F.sequence(first, last)))
    ends = genome.groupBy("chrom").agg(F.floor((F.max("piece").cast("bigint") * CHUNK) / SPAN).alias("last"))
    every = ends.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("tile"), F.lit(3).alias("kind"))
    within = allowed is not None
    parts = tiles.unionByName(every, allowMissingColumns=True).select("chrom", "tile", "kind", "low", "high", "seq")

    def planes(tile: int, pieces: dict, twice: set, spans: dict) -> bytes:
        codes = np.full(width, 2, np.uint8)
        for at, seq in pieces.items():
            begin = at - tile * SPAN
            if at not in twice:
                part = seq[max(0, -begin) : max(0, width - begin)]
                codes[max(0, begin) : max(0, begin) + len(part)] = np.frombuffer(part, np.uint8)
        covered = {}
        for kind, ranges in spans.items():
            steps = np.zeros(width + 1, np.int32)
            for a, b in ranges:
                np.add.at(steps, np.clip(a - tile * SPAN, 0, width), 1)
                np.add.at(steps, np.clip(b - tile * SPAN, 0, width), -1)
            covered[kind] = np.cumsum(steps[:-1]) > 0
        shut = covered[1] | ~covered[2] if within else covered[1]
        return np.packbits(np.concatenate([codes & 1, codes >> 1, shut.astype(np.uint8)])).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, twice, spans = None, {}, set(), {1: [], 2: []}
        told = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([planes(held[1], pieces, twice, spans)], pa.binary())], names=["chrom", "tile", "planes"])
        for batch in batches:
            chrom, tile, kind, low, high, seq = (batch.column(k) for k in range(6))
            kinds, lows, highs = kind.to_numpy(), low.fill_null(0).to_numpy(), high.fill_null(0).to_numpy()
            cuts = _cuts([chrom, tile])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                row = (chrom[lo].as_py(), tile[lo].as_py())
                if row != held:
                    if held is not None:
                        yield told()
                    held, pieces, twice, spans = row, {}, set(), {1: [], 2: []}
                for at in (np.flatnonzero(kinds[lo:hi] == 0) + lo).tolist():
                    text = seq[at].as_py()
                    if text is not None:
                        text = text if text.isascii() else text.decode("utf-8", "replace").encode("ascii", "replace")
                        (twice.add if lows[at] in pieces else lambda _: None)(lows[at])
                        pieces[lows[at]] = text.translate(_CODES)
                for k in spans:
                    some = kinds[lo:hi] == k
                    if some.any():
                        spans[k].append((lows[lo:hi][some], highs[lo:hi][some]))
        if held is not None:
            yield told()

    size = ends.agg(F.sum("last")).first()[0] or 0
    many = max(genome.sparkSession.sparkContext.defaultParallelism, size // TILES)
    sorted_ = parts.repartition(many, "chrom", "tile").sortWithinPartitions("chrom", "tile")
    return sorted_.mapInArrow(run, "chrom string, tile bigint, planes binary")


def _region_counts(regions: DataFrame, store: DataFrame) -> DataFrame:
    """regions that meet no shut letter, with known and strong, the numbers of such letters, from the planes of counted.

    A task reads the planes of a tile and then streams the regions that start there past them. Rows are
    sorted by one number, a digest of the tile; tiles that share it are held together."""
    names = regions.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema.fields)

    def words(planes: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
        """The planes and a fourth of missing letters as words of 64 letters, the first in the highest bit, and the bits before each word."""
        bits = np.zeros((4, len(planes.as_buffer()) // 24 + 1), np.uint64)
        bits[:3, :-1] = np.frombuffer(planes.as_buffer(), ">u8").reshape(3, -1)
        bits[3] = bits[1] & ~bits[0]
        before = np.zeros(bits.shape, np.int32)
        np.cumsum(np.bitwise_count(bits[:, :-1]), axis=1, out=before[:, 1:])
        return bits, before

    def told(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of each plane before letters."""
        word, rest = at >> 6, (63 - (at & 63)).astype(np.uint64)
        return before[:, word] + np.bitwise_count((bits[:, word] >> np.uint64(1)) >> rest).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, of = {}, None
        for batch in batches:
            chrom, codes, planes = batch.column("chrom"), batch.column("code_").to_numpy(), batch.column("planes")
            starts, ends = (batch.column(c).fill_null(0).to_numpy() for c in ("start", "end"))
            keep, known, strong = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if codes[lo] >> 1 != of:
                    tiles, of = {}, codes[lo] >> 1
                if not codes[lo] & 1:
                    tiles |= {(chrom[at].as_py(), starts[at]): words(planes[at]) for at in range(lo, hi)}
                    continue
                lost = np.ones(hi - lo, bool)
                for (name, base), (bits, before) in tiles.items():
                    own = pc.equal(chrom.slice(lo, hi - lo), name).to_numpy(zero_copy_only=False)
                    own &= (starts[lo:hi] >= base) & (starts[lo:hi] < base + SPAN) & (ends[lo:hi] - base < bits.shape[1] * 64 - 63)
                    rows = np.flatnonzero(own) + lo
                    inside = told(bits, before, ends[rows] - base) - told(bits, before, starts[rows] - base)
                    lost[rows - lo] = (inside[2] == 0) & (inside[3] > 0)
                    keep[rows], known[rows], strong[rows] = inside[2] == 0, inside[0], inside[1] - inside[3]
                if lost.any():
                    at = lo + int(np.argmax(lost))
                    raise ValueError(f"a region leaves the genome or meets a piece twice: {chrom[at]} {starts[at]} {ends[at]}")
            if keep.any():
                whole = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(known), pa.array(strong)], names=[*names, "known", "strong"])
                yield whole.filter(pa.array(keep))

    both = regions.unionByName(store.select("chrom", (F.col("tile") * SPAN).alias("start"), "planes"), allowMissingColumns=True)
    tile = F.floor(F.col("start") / SPAN)
    coded = both.withColumn("code_", F.xxhash64("chrom", tile).bitwiseAND(F.lit(-2)) + F.col("planes").isNull().cast("bigint"))
    sorted_ = coded.repartition(store.rdd.getNumPartitions(), "chrom", tile).sortWithinPartitions("code_")
    return sorted_.mapInArrow(run, f"{kinds}, known bigint, strong bigint")


def _conflicts(proposals: DataFrame) -> DataFrame:
    """(first, second): overlapping proposals of different keys, the earlier in order first."""
    pairs = overlap_pairs(proposals, proposals, ["place", "key_"], ["place", "key_"])
    return pairs.where("place < other_place and key_ <> other_key_").select(F.col("place").alias("first"), F.col("other_place").alias("second"))


class _Taken:
    """What a pass in order has taken of a chromosome: disjoint places, sorted, and the keys that they serve."""

    def __init__(self) -> None:
        self.starts, self.ends, self.keys = (np.zeros(0, np.int64) for _ in range(3))

    def passed(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the next proposals are taken. Keys must not fall: a key comes once a turn."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        fine = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if len(self.ends):
            at = np.searchsorted(self.ends, starts, "right")
            fine &= (at == len(self.ends)) | (self.starts[np.minimum(at, len(self.ends) - 1)] >= ends)
        left, found = np.flatnonzero(fine), [np.zeros(0, np.int64)]
        while len(left):
            # a key's first proposal that overlaps none that is left is taken, whatever becomes of others
            by, here, there = keys[left], starts[left], ends[left]
            head = np.r_[True, by[1:] != by[:-1]]
            order = np.argsort(here, kind="stable")
            near, far, touched = here[order], there[order], np.zeros(len(left), bool)
            touched[order[1:]] = near[1:] < np.maximum.accumulate(far)[:-1]
            touched[order[:-1]] |= near[1:] < far[:-1]
            now = head & ~touched
            found.append(left[now])
            rest = ~now[np.flatnonzero(head)][np.cumsum(head) - 1]
            more, left = now.sum() * 8 > head.sum(), left[rest]
            if not more:
                break
        found.append(self._one_by_one(keys, starts, ends, left))
        taken = np.sort(np.concatenate(found))
        order = taken[np.argsort(starts[taken], kind="stable")]
        at = np.searchsorted(self.starts, starts[order])
        self.starts, self.ends = np.insert(self.starts, at, starts[order]), np.insert(self.ends, at, ends[order])
        self.keys = np.insert(self.keys, np.searchsorted(self.keys, keys[taken]), keys[taken])
        return taken

    @staticmethod
    def _one_by_one(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray) -> np.ndarray:
        held, found, served = [], [], None
        for at, key, start, end in zip(left.tolist(), keys[left].tolist(), starts[left].tolist(), ends[left].tolist(), strict=True):
            if key != served:
                k = bisect.bisect_left(held, (start, end))
                if (k == len(held) or held[k][0] >= end) and (k == 0 or held[k - 1][1] <= start):
                    held.insert(k, (start, end))
                    found.append(at)
                    served = key
        return np.array(found, np.int64)


def first_fits(proposals: DataFrame, few: int = FEW) -> DataFrame:
    """Of proposals (place, key_, chrom, start, end) those that a pass in order of place takes: each whose key is not served and that overlaps none taken. Places go by turns, and in a turn by keys.

    A key is of one chromosome, so chromosomes do not touch each other. Where none has more than
    few open proposals, each is passed in order by a task of its own, as a stream of sorted rows:
    the task holds the places that it took and no group. Beyond that a proposal with no open one
    before it in its key and none before it that overlaps it is taken, all of these at once; what
    they exclude is closed, and so on until few are open. That is the result of the pass in order."""
    open_ = proposals
    taken = None
    edges = None
    while True:
        left = open_.groupBy("chrom").count().agg(F.max("count")).first()[0] or 0
        if left <= few:
            break
        if edges is None:
            open_ = checkpointed(open_)
            edges = checkpointed(_conflicts(open_))
        heads = open_.groupBy("key_").agg(F.min("place").alias("place")).select("place")
        live = edges.join(open_.select(F.col("place").alias("first")), "first", "left_semi")
        now = checkpointed(open_.join(heads, "place", "left_semi").join(live.select(F.col("second").alias("place")).distinct(), "place", "left_anti"))
        shut = edges.join(now.select(F.col("place").alias("first")), "first", "left_semi").select(F.col("second").alias("place")).distinct()
        open_ = checkpointed(open_.join(shut, "place", "left_anti").join(now.select("key_"), "key_", "left_anti").select(*proposals.columns))
        taken = now if taken is None else taken.unionByName(now)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = collections.defaultdict(_Taken)
        for batch in batches:
            names = batch.column("chrom").dictionary_encode()
            keys, starts, ends = (batch.column(c).to_numpy() for c in ("key_", "start", "end"))
            numbers, kept = names.indices.to_numpy(), []
            for number, chrom in enumerate(names.dictionary.to_pylist()):
                own = np.flatnonzero(numbers == number)
                turns = [0, *(np.flatnonzero(np.diff(keys[own]) < 0) + 1).tolist(), len(own)]
                for lo, hi in zip(turns[:-1], turns[1:], strict=True):
                    rows = own[lo:hi]
                    kept.append(rows[held[chrom].passed(keys[rows], starts[rows], ends[rows])])
            if kept:
                yield batch.take(pa.array(np.sort(np.concatenate(kept))))

    # by ranges a large chromosome has a partition of its own; rows are sorted by one number
    parts = 2 * open_.sparkSession.sparkContext.defaultParallelism
    last = open_.repartitionByRange(parts, "chrom").sortWithinPartitions("place").mapInArrow(take, open_.schema)
    return last if taken is None else taken.unionByName(last)


def matched_controls(positives: DataFrame, genome: DataFrame, forbidden: DataFrame, allowed: DataFrame | None = None, ratios: dict[str, int] | None = None, rounds: int = 4, tries: int = 16, tolerance: float = 0.05, most_unknown: float = 0.1, seed: int = 20260915, strict: bool = True, few: int = FEW) -> DataFrame:
    """split, record_id, negative_index, chrom, start, end, gc, negative_gc, attempt: controls for positives (record_id, split, chrom, seq), one for each in train and ten in test.

    A key (positive and index) proposes starts by keyed digest, in attempt order; train keys go
    through all rounds before test keys. A proposal must miss forbidden, lie in allowed where
    given, have few unknown letters and the positive's GC content within tolerance, and overlap
    none taken before it, in the order of split, round, record, index and attempt. That is one
    pass over the attempts of all keys; a key's attempts behind the one that serves it change
    nothing, so they are made only for keys that the pass so far leaves without a control, until
    there is none or it has made all. A key that no round serves fails the job or, if
    not strict, comes back without a place.

    Keys are numbered in order of record and index, and attempts move as numbers only: first to
    the tile of the counted genome where they start, then those that fit to the pass. A place in
    the pass is turn, key and attempt in one number."""
    ratios = ratios or CONTRACT
    every, most, total = list(ratios), max(1, *ratios.values()), rounds * tries
    among = lambda of: F.coalesce(*[F.when(F.col("split") == s, F.lit(r)) for s, r in of.items()], F.lit(0))
    sizes = genome.groupBy("chrom").agg((F.max("piece") + 1).alias("pieces"))
    wanted = positives.withColumn("wanted", among(ratios)).where("wanted > 0").select("split", "record_id", "chrom", "wanted", F.length("seq").alias("length"), gc_fraction(F.col("seq")).alias("gc"))
    ordered = checkpointed(wanted.select("record_id").distinct().sort("record_id").withColumn("record_", F.monotonically_increasing_id()))
    sized = wanted.join(ordered, "record_id").join(broadcast_if_small(sizes, 10_000), "chrom", "left").withColumn("last", F.coalesce("pieces", F.lit(0)) * CHUNK - F.col("length"))
    indexed = sized.withColumn("negative_index", F.explode(F.sequence(F.lit(1), F.col("wanted"))))
    key, turn = F.col("record_") * most + F.col("negative_index") - 1, among({s: k * rounds for k, s in enumerate(every)})
    keys = checkpointed(indexed.select(key.alias("key_"), "split", "record_id", "negative_index", "chrom", "length", "gc", "last", turn.alias("turn")))
    reach, bound = keys.agg(F.max("length"), F.max("key_") + 1).first()
    cores = genome.sparkSession.sparkContext.defaultParallelism
    with row_batches(genome.sparkSession):
        store = checkpointed(counted(genome, forbidden, allowed, reach or 0))
    attempt = F.expr(f"cast(place div {tries} div {bound or 1} % {rounds} * {tries} + place % {tries} as int)")

    def fitting(tried: DataFrame) -> DataFrame:
        """The proposals of keys with attempts that fit by themselves."""
        target = F.concat("record_id", F.lit("|negative="), F.col("negative_index").cast("string"))
        proposals = tried.withColumn("start", keyed_start(seed, target, F.col("attempt"), F.col("last"))).withColumn("end", F.col("start") + F.col("length"))
        place = ((F.col("turn") + F.floor(F.col("attempt") / tries)) * F.lit(bound).cast("bigint") + F.col("key_")) * tries + F.col("attempt") % tries
        read = region_sequences(proposals.select("chrom", "start", "end", place.alias("place"), "gc"), store)
        size, known = F.col("end") - F.col("start"), F.col("known")
        negative_gc = F.when(known == 0, 0.0).otherwise(F.col("strong") / F.greatest(known, F.lit(1)))
        unknown = F.when(size == 0, 1.0).otherwise((size - known) / F.greatest(size, F.lit(1)))
        fit = read.withColumn("negative_gc", negative_gc).where((unknown <= most_unknown) & (F.abs(F.col("negative_gc") - F.col("gc")) <= tolerance + 1e-12))
        return checkpointed(fit.select("place", F.expr(f"place div {tries} % {bound}").alias("key_"), "chrom", "start", "end", "gc", "negative_gc").repartition(cores, "key_"))

    asked = keys.where(F.col("last") >= 0).withColumn("made_", F.lit(0))
    upto = min(FIRST, total) if asked.count() > WAVES else total
    found = spots = None
    while True:
        served = asked.withColumn("served_", F.lit(None).cast("boolean")) if spots is None else asked.join(spots.select("key_", F.lit(True).alias("served_")), "key_", "left")
        more = F.when(F.col("served_").isNull(), F.greatest(F.lit(upto), F.col("made_"))).otherwise(F.col("made_"))
        marked = checkpointed(served.withColumn("upto_", more).drop("served_"))
        todo = marked.where("upto_ > made_")
        if upto == total and not todo.take(1):
            break
        # few keys with many attempts would lie in one partition
        spread = todo.repartition(store.rdd.getNumPartitions(), "key_")
        with row_batches(genome.sparkSession):
            made = fitting(spread.withColumn("attempt", F.explode(F.sequence(F.col("made_"), F.col("upto_") - 1))))
            found = made if found is None else found.unionByName(made)
            spots = checkpointed(first_fits(found, few))
        asked = marked.drop("made_").withColumnRenamed("upto_", "made_")
        upto = min(upto * GROWTH, total)
    shown = ["split", "record_id", "negative_index", "chrom", "start", "end", "gc", "negative_gc", "attempt"]
    if spots is not None:
        split = F.element_at(F.array(*map(F.lit, every)), F.expr(f"cast(place div {tries} div {bound} div {rounds} as int) + 1"))
        taken = spots.withColumns({"split": split, "attempt": attempt}).join(keys.select("key_", "record_id", "negative_index").distinct(), "key_")
    else:
        taken = keys.limit(0).withColumns({"start": F.lit(0).cast("bigint"), "end": F.lit(0).cast("bigint"), "negative_gc": F.col("gc"), "attempt": F.lit(0)})
    missing = keys.join(taken.select("key_"), "key_", "left_anti")
    taken = taken.select(*shown)
    if strict:
        lost = missing.count()
        if lost:
            first = missing.orderBy("record_id", "negative_index").limit(5).collect()
            raise RuntimeError(f"{lost} controls not matched after {rounds} rounds with tolerance {tolerance}: " + ", ".join(f"{r['record_id']} (GC={r['gc']:.3f})" for r in first))
        return taken
    return taken.unionByName(missing.select("split", "record_id", "negative_index", "chrom", "gc"), allowMissingColumns=True)


def negative_pairs(positives: DataFrame, controls: DataFrame) -> DataFrame:
    """The pair table of positives (record_id, split, chrom, start, end) and their controls; negative_id is a digest of record and index."""
    digest = F.substring(F.sha2(F.concat_ws("|", "record_id", F.col("negative_index").cast("string")), 256), 1, 16)
    own = positives.select("record_id", F.col("chrom").alias("positive_chrom"), F.col("start").alias("positive_start"), F.col("end").alias("positive_end"))
    fields = controls.select("split", "record_id", "negative_index", F.concat(F.lit("neg_"), "split", F.lit("_"), digest).alias("negative_id"), F.col("chrom").alias("negative_chrom"), F.col("start").alias("negative_start"), F.col("end").alias("negative_end"), F.col("gc").alias("positive_gc"), "negative_gc", F.abs(F.col("gc") - F.col("negative_gc")).alias("gc_delta"), F.col("attempt").alias("candidate_attempt"))
    return own.join(fields, "record_id").withColumnRenamed("record_id", "positive_id")


def sample_negatives(positives: DataFrame, genome: DataFrame, forbidden: DataFrame, ratios: dict[str, int] | None = None, **settings) -> DataFrame:
    """The pair table of positives and their controls, ordered by split, positive_id and negative_index; other ratios than those of CONTRACT are refused."""
    if ratios not in (None, CONTRACT):
        raise ValueError(f"the protocol has {CONTRACT} controls for each positive")
    controls = matched_controls(positives, genome, forbidden, ratios=CONTRACT, **settings)
    return negative_pairs(positives, controls).orderBy("split", "positive_id", "negative_index")


def cross_split_overlaps(controls: DataFrame) -> DataFrame:
    """n_overlaps: how many test controls overlap a train control."""
    hit = overlapping(controls.where("split = 'test'"), controls.where("split = 'train'"))
    return hit.agg(F.count("*").alias("n_overlaps"))
