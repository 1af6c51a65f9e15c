"""Operators against small cases worked out by hand or by a plain loop."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe import views
from helixframe.functions import dna, keyed
from helixframe.operators import cohorts, comparison, diagnostics, discovery, evaluation, extensions, intervals, ladders, ranking, regression, sampling, sequences, splits
from helixframe.plans.materialise import checkpointed
from helixframe.plans.running import ranked, tiled


def regions(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start bigint, end bigint")


def test_merge_joins_touching_but_groups_do_not(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 15, 30), ("a", 31, 40), ("b", 5, 6)]
    got = sorted(map(tuple, intervals.merged(regions(spark, rows)).collect()))
    assert got == [("a", 0, 30, 3), ("a", 31, 40, 1), ("b", 5, 6, 1)]
    full = spark.createDataFrame([(*r, f"r{k}", float(k)) for k, r in enumerate(rows)], "chrom string, start bigint, end bigint, record_id string, score double")
    groups = intervals.group_table(intervals.overlap_groups(full)).select("chrom", "start", "end", "n_intervals", "score").collect()
    assert sorted(map(tuple, groups)) == [("a", 0, 10, 1, 0.0), ("a", 10, 30, 2, 1.5), ("a", 31, 40, 1, 3.0), ("b", 5, 6, 1, 4.0)]


def test_interval_joins_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TILE", 16)
    monkeypatch.setattr(intervals, "BIN", 8)
    rng = random.Random(3)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randint(1, 40)) for s in (rng.randrange(400) for _ in range(n))]
    left, right = make(120), make(25)
    got = sorted(map(tuple, intervals.overlapping(regions(spark, left), regions(spark, right)).collect()))
    hit = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    assert got == sorted(x for x in left if any(hit(x, y) for y in right))
    rest = sorted(map(tuple, intervals.overlapping(regions(spark, left), regions(spark, right), keep=False).collect()))
    assert rest == sorted(x for x in left if not any(hit(x, y) for y in right))
    covered = {(c, p) for c, s, e in right for p in range(s, e)}
    inside = sorted(map(tuple, intervals.contained(regions(spark, left), regions(spark, right)).collect()))
    assert inside == sorted(x for x in left if all((x[0], p) in covered for p in range(x[1], x[2])))
    merged = intervals.merged(regions(spark, left)).collect()
    assert sum(r.end - r.start for r in merged) == len({(c, p) for c, s, e in left for p in range(s, e)})


def test_invalid_region_fails(spark):
    with pytest.raises(Exception, match="invalid region"):
        intervals.checked(regions(spark, [("a", 5, 5)])).collect()


def test_alias_order(spark):
    sizes = spark.createDataFrame([("chr1", 100), ("2", 100), ("chrM", 50)], "chrom string, size bigint")
    rows = regions(spark, [("1", 0, 10), ("chr2", 0, 10), ("MT", 0, 10), ("chr1", 0, 200), ("zz", 0, 1)])
    got = {r.source_chrom + str(r.end): (r.chrom, r.outcome) for r in intervals.on_chromosomes(rows, sizes).collect()}
    assert got == {"110": ("chr1", "renamed"), "chr210": ("2", "renamed"), "MT10": ("chrM", "renamed"), "chr1200": ("chr1", "beyond"), "zz1": (None, "unknown")}


def test_bins_and_allocation(spark):
    groups = spark.createDataFrame([(f"g{k}", "a", float(k)) for k in range(7)], "group_id string, chrom string, score double")
    assert [r.bin for r in splits.score_bins(groups, 5).orderBy("score").collect()] == [0, 0, 1, 2, 2, 3, 4]
    many = spark.createDataFrame([(f"g{k}", "ab"[k % 2], float(k % 13)) for k in range(101)], "group_id string, chrom string, score double")
    split = splits.assigned(many, 0.2, 1, 3)
    assert split.where("split = 'test'").count() == 20
    assert split.count() == 101


def test_ranked_matches_sorted(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.choice([1, 2, 2, 3, 900]))) for k in range(300)]
    got = {r.k: r["rank"] for r in ranked(spark.createDataFrame(rows, "k int, v double"), "v", ["k"]).collect()}
    assert got == {k: i for i, (v, k) in enumerate(sorted((v, k) for k, v in rows))}


def test_ranking_against_loops(spark):
    rng = random.Random(1)
    rows = [("g", rng.randint(0, 1), float(rng.randint(0, 9))) for _ in range(200)] + [("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, label int, score double")
    g = [(label, s) for k, label, s in rows if k == "g"]
    pos, neg = [s for label, s in g if label], [s for label, s in g if not label]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(sum(label for label, s in g if s == t) * sum(label for label, s in g if s >= t) / sum(1 for _, s in g if s >= t) for t in {s for _, s in g}) / len(pos)
    assert {r.k: r.auroc for r in ranking.auroc(df, ["k"]).collect()} == {"g": pytest.approx(auc), "one": None}
    assert {r.k: r.ap for r in ranking.average_precision(df, ["k"]).collect()} == {"g": pytest.approx(ap), "one": None}
    threshold = diagnostics.thresholds(df.where("k = 'g'"), ["k"], 0.1).first().threshold
    best = min((t for t in {s for _, s in g} if sum(n >= t for n in neg) <= 0.1 * len(neg)), default=None)
    assert threshold == best


def test_sign_flip_and_trapezoid(spark):
    d = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 2.0, -0.5])], "g string, k int, d double")
    r = ranking.sign_flip(d, ["g"]).first()
    assert (r.n_pairs, r.total, r.extreme) == (3, 8, 4)
    points = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 3.0)], "g string, x double, y double")
    assert ranking.trapezoid(points, ["g"]).first().area == 7.0
    many = [("b", float(k * k), float(k % 5)) for k in range(400)]
    want = sum((x2 - x1) * (y1 + y2) / 2 for (_, x1, y1), (_, x2, y2) in zip(many, many[1:], strict=False))
    assert ranking.trapezoid(spark.createDataFrame(many, "g string, x double, y double"), ["g"]).first().area == pytest.approx(want)
    with pytest.raises(Exception, match="two points"):
        ranking.trapezoid(spark.createDataFrame([("a", 0.0, 1.0)], "g string, x double, y double"), ["g"]).collect()
    with pytest.raises(Exception, match="unique"):
        ranking.trapezoid(spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0)], "g string, x double, y double"), ["g"]).collect()


def test_tiles_hold_equal_shares_whatever_the_spread(spark):
    rows = [(k, 1.0 / (k + 1)) for k in range(5000)] + [(-1, 1e12), (-2, None)]
    tiles = tiled(spark.createDataFrame(rows, "k int, v double").withColumn("g", F.lit(1)), ["g"], "v").groupBy("tile").count().collect()
    assert len(tiles) > 200 and max(r["count"] for r in tiles) < 60
    order = tiled(spark.createDataFrame(rows, "k int, v double").withColumn("g", F.lit(1)), ["g"], "v").where("v is not null").orderBy("v").select("tile").collect()
    assert all(a.tile <= b.tile for a, b in zip(order, order[1:], strict=False))


def exchanges(df):
    """Shuffles of the plan that was run."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    return sum("Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x for x in lines)


def test_split_needs_few_shuffles(spark):
    from helixframe import registry

    for name in ("split_assign", "score_bins", "interval_group_ids"):
        assert exchanges(registry.queries()[name](spark, "/root/testdata/sf0.001")) <= 12, name


def draws(seed, group, replicates, n):
    text = lambda r, j: "|".join([str(seed), *group, str(r), str(j)])
    return [[int(hashlib.sha256(text(r, j).encode()).hexdigest()[:8], 16) % n for j in range(n)] for r in range(replicates)]


def test_bootstraps_against_loops(spark):
    values = [float(k % 7) for k in range(60)]
    d = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "g string, k bigint, d double")
    r = ranking.bootstrap_mean(d, ["g"], seed=1, replicates=300).first()
    means = [np.mean([values[k] for k in one]) for one in draws(1, ["a"], 300, 60)]
    assert (r.lower, r.upper) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    assert r.lower < r["mean"] < r.upper
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), k % 6, float(rng.randint(0, 20)), float(rng.randint(0, 20))) for k in range(120)]
    got = {x.replicate: x.delta for x in extensions.block_bootstrap(spark.createDataFrame(rows, "label int, block int, one double, two double"), "block", "one", "two", 40, 5).collect()}
    for k, one in enumerate(draws(5, [], 40, 6)):
        picked = [x for b in one for x in rows if x[1] == b]

        def ap(at, picked=picked):
            pos = sum(x[0] for x in picked)
            return sum(sum(x[0] for x in picked if x[at] == t) * sum(x[0] for x in picked if x[at] >= t) / sum(1 for x in picked if x[at] >= t) for t in {x[at] for x in picked}) / pos

        assert got[k] == pytest.approx(ap(3) - ap(2))


def test_dna(spark):
    row = spark.createDataFrame([("ACGTNNgc", ""), ], "s string, e string").select(
        dna.gc_fraction(F.col("s")).alias("gc"), dna.n_fraction(F.col("s")).alias("n"), dna.gc_fraction(F.col("e")).alias("gc0"), dna.n_fraction(F.col("e")).alias("n0"),
        dna.reverse_complement(F.lit("AACG")).alias("rc"), dna.kmers(F.lit("ACGT"), 3).alias("k"), dna.kmers(F.lit("AC"), 3).alias("k0"),
        keyed.minus_log10(F.lit("1.2e-400")).alias("e"), keyed.minus_log10(F.lit("0.001")).alias("e3"),
    ).first()
    assert (row.gc, row.n, row.gc0, row.n0) == (4 / 6, 0.25, 0.0, 1.0)
    assert (row.rc, row.k, row.k0) == ("CGTT", ["ACG", "CGT"], [])
    assert row.e == pytest.approx(400 - math.log10(1.2)) and row.e3 == pytest.approx(3)


MATRIX = [[0.05, 0.8, 0.05, 0.1], [0.25, 0.3, 0.1, 0.35], [0.6, 0.15, 0.15, 0.1], [0.02, 0.08, 0.88, 0.02]]


@pytest.mark.parametrize("metric", ["jsd", "tv", "hellinger"])
def test_motif_distance(spark, metric):
    flip = [r[::-1] for r in MATRIX[::-1]]
    rolled = [r[1:] + r[:1] for r in MATRIX]
    df = spark.createDataFrame([(0, MATRIX, MATRIX), (1, MATRIX, flip), (2, MATRIX, rolled), (3, MATRIX, MATRIX[:1])], "k int, a array<array<double>>, b array<array<double>>")
    got = {r.k: r for r in sequences.motif_distances(df, metric).collect()}
    assert got[0].distance == pytest.approx(0, abs=1e-12) and got[0].strand == "+" and got[0]["shift"] == 0
    assert got[1].distance == pytest.approx(0, abs=1e-12) and got[1].strand == "-"
    assert 0 < got[2].distance <= 1
    assert got[3].distance is None


def test_words_are_counted_across_borders_and_strands(spark, monkeypatch):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGTNacgt") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None, "", "A"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    flip = {"A": "T", "C": "G", "G": "C", "T": "A"}
    for both in (False, True):
        want = {k: Counter() for k in (1, 2, 3)}
        for s in filter(None, seqs):
            for strand in [s.upper(), "".join(flip.get(c, c) for c in reversed(s.upper()))][: 1 + both]:
                for k in want:
                    want[k].update(w for w in (strand[i : i + k] for i in range(len(strand) - k + 1)) if set(w) <= set("ACGT"))
        for k in want:
            assert {r.word: r.n for r in sequences.kmer_counts(df, k, both).collect()} == want[k]
        got = {r.word: r.freq for r in sequences.markov_table(df, 2, 0.5, both).collect()}
        assert len(got) == 84 and all(abs(f - (want[len(w)][w] + 0.5 / 4 ** len(w)) / (want[len(w)].total() + 0.5)) < 1e-12 for w, f in got.items())
    assert {r.freq for r in sequences.markov_table(df.limit(0), 0).collect()} == {0.25}
    monkeypatch.setattr(sequences, "PIECE", 5)
    column = pa.array(seqs)
    for overlap in (0, 2, 9):
        words = Counter()
        for row, first, codes in sequences._pieces(column, overlap):
            assert len(row) == len(first)
            words.update(sequences._words(codes, overlap + 1)[sequences._known(codes, overlap + 1)].tolist())
        want = Counter(w for s in filter(None, seqs) for w in (s.upper()[i : i + overlap + 1] for i in range(len(s) - overlap)) if set(w) <= set("ACGT"))
        assert sorted(words.values()) == sorted(want.values())


def test_hundreds_of_motifs_in_one_pass(spark):
    rng = np.random.default_rng(4)
    motifs = [(k, rng.dirichlet([0.4] * 4, int(rng.integers(3, 14))).tolist()) for k in range(300)]
    seqs = [(k, "".join(rng.choice(list("ACGT"), int(rng.integers(20, 90))))) for k in range(40)]
    df, held = spark.createDataFrame(seqs, "doc_id int, seq string"), spark.createDataFrame(motifs, "motif_id int, pwm array<array<double>>")
    found = sequences.scan(df, held, dict(zip("ACGT", [0.3, 0.2, 0.2, 0.3], strict=True)), 0)
    assert found._jdf.queryExecution().toString().count("MapInArrow") <= 4  # logical, analysed, optimised and physical: one pass
    got = {(r.doc_id, r.motif_id): r.max_log_odds for r in found.collect()}
    assert len(got) == 300 * 40
    back = np.log([0.3, 0.2, 0.2, 0.3])
    for doc, motif in rng.choice(40 * 300, 200, replace=False)[:, None] // [300, 1] % [40, 300]:
        codes = np.array(["ACGT".index(c) for c in seqs[doc][1]])
        m = np.log(np.array(motifs[motif][1]))
        best = max(sum(x[j, codes[at + j]] - back[codes[at + j]] for j in range(len(m))) for at in range(len(codes) - len(m) + 1) for x in (m, m[::-1, ::-1]))
        assert got[int(doc), int(motif)] == pytest.approx(best)


def test_scanner_against_a_loop(spark, monkeypatch):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.2 else "ACGT") for _ in range(30)) for _ in range(12)]
    words = {w: 0.05 + rng.random() for k in (1, 2, 3) for w in map("".join, __import__("itertools").product("ACGT", repeat=k))}

    def slow(seq, order):
        best = -math.inf
        for at in range(len(seq) - 3):
            word = seq[at : at + 4]
            if "N" in word:
                continue
            head = min(order + 1, 4)
            below = math.log(words[word[:head]])
            for j in range(head, 4):
                below += math.log(words[word[j - order : j + 1]]) - (math.log(words[word[j - order : j]]) if order else 0)
            for m in (MATRIX, [r[::-1] for r in MATRIX[::-1]]):
                best = max(best, sum(math.log(m[j]["ACGT".index(c)]) for j, c in enumerate(word)) - below)
        return best

    df = spark.createDataFrame(list(enumerate(seqs)), "doc_id bigint, seq string")
    motifs = spark.createDataFrame([(7, MATRIX)], "motif_id bigint, pwm array<array<double>>")
    for order in (0, 1, 2):
        got = {r.doc_id: r.max_log_odds for r in sequences.scan(df, motifs, words, order).collect()}
        assert got == {k: pytest.approx(slow(s, order)) for k, s in enumerate(seqs)}
    monkeypatch.setattr(sequences, "PIECE", 7)  # a kernel of its own below: the workers have their own
    scanner = sequences.Scanner([(7, MATRIX), (8, MATRIX + MATRIX[:3])], words, 1)
    for seq in seqs:
        parts = [x for _, first, codes in sequences._pieces(pa.array([seq]), 6) for x in scanner.best(codes, first)]
        assert max(x.max() for k, x in parts if k == 7) == pytest.approx(slow(seq, 1))
    with pytest.raises(Exception, match="finite score"):
        sequences.scan(spark.createDataFrame([(0, "N" * 9)], "doc_id bigint, seq string"), motifs, words, 0).collect()


def test_partial_r_equals_a_direct_fit(spark):
    rng = np.random.default_rng(11)
    rows = []
    for cell in range(3):
        for t in range(1, 8):
            d, c1, c2 = rng.normal(cell * 5, 1), rng.normal(-cell, 2), rng.normal(0, 1)
            rows.append((cell, t, float(1.5 * d - c1 + 0.3 * c2 + 10 * cell + rng.normal()), float(d), float(c1), float(c2)))
    df = spark.createDataFrame(rows, "cell int, t int, y double, d double, c1 double, c2 double")
    cols = ["y", "d", "c1", "c2"]
    got = regression.partial_statistics(regression.pooled(regression.moments(df, ["cell"], "t", cols), ["cell"], [], cols), "y", "d", ["c1", "c2"], cols).first()
    a = np.array(rows)
    for c in range(3):
        a[a[:, 0] == c, 2:] -= a[a[:, 0] == c, 2:].mean(0)
    y, d, x = a[:, 2], a[:, 3], a[:, 4:]
    res = lambda v, m: v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
    assert got.partial_r == pytest.approx(np.corrcoef(res(y, x), res(d, x))[0, 1], abs=1e-9)
    r2 = lambda m: 1 - (res(y, m) ** 2).sum() / (y**2).sum()
    assert got.baseline_r2 == pytest.approx(r2(x), abs=1e-9) and got.full_r2 == pytest.approx(r2(np.c_[x, d]), abs=1e-9)
    centred = regression.centred(spark.createDataFrame([("a", 1.0), ("a", 8.0), ("b", 30.0), ("b", 20.0)], "g string, v double"), ["g"], ["v"])
    assert sorted(r.v for r in centred.collect()) == [-5, -3.5, 3.5, 5]


def test_bootstrap_keeps_trajectory_counts(spark):
    parts = spark.createDataFrame([(t, 1) for t in range(9)], "t int, n int")
    w = regression.bootstrap_weights(parts, "t", 20, 3).groupBy("replicate").agg(F.sum("weight").alias("w")).collect()
    assert len(w) == 20 and all(r.w == 9 for r in w)
    two = spark.createDataFrame([(c, t, k) for c in "xy" for t in range(4) for k in range(5)], "c string, t int, k int")
    rows = two.join(regression.bootstrap_weights(two, "t", 30, 3, "c"), ["c", "t"]).groupBy("replicate", "c").agg(F.sum("weight").alias("n")).collect()
    assert len(rows) == 60 and all(r.n == 20 for r in rows)


def test_ladder_is_nested(spark):
    pairs = spark.createDataFrame([(s, k, k, -k) for s in (1, 2) for k in range(20)], "sample int, slot int, positive_id int, negative_id int")
    rows = ladders.nested(pairs, ["sample"], [100, 50, 0], 20, 5).collect()
    out = {(r.sample, r.level): {q.slot for q in rows if q.sample == r.sample and q.level == r.level and q.source == "negative"} for r in rows}
    assert [len(out[1, x]) for x in (100.0, 50.0, 0.0)] == [0, 10, 20]
    with pytest.raises(ValueError):
        ladders.ladder_counts([33.0], 20)


def test_matched_controls(spark):
    rng = random.Random(4)
    pieces = [("a", k, "".join(rng.choice("ACGT") for _ in range(sampling.CHUNK))) for k in range(12)]
    genome = spark.createDataFrame(pieces, "chrom string, piece bigint, seq string")
    whole = "".join(p[2] for p in pieces)
    positives = spark.createDataFrame([(f"p{k}", "train" if k % 2 else "test", "a", whole[k * 50 : k * 50 + 60]) for k in range(16)], "record_id string, split string, chrom string, seq string")
    forbidden = regions(spark, [("a", 1000, 3000)])
    two = {"train": 1, "test": 2}
    got = sampling.matched_controls(positives, genome, forbidden, tolerance=0.1, ratios=two, few=0).collect()
    assert len(got) == 8 + 16
    # by hand, in order
    free, want = [True] * 1000 + [False] * 2000 + [True] * 9000, {}
    for split, most in (("train", 1), ("test", 2)):
        keys = sorted((f"p{k}", i) for k in range(16) if (k % 2 == 1) == (split == "train") for i in range(1, most + 1))
        for turn in range(4):
            for record, index in keys:
                for attempt in range(turn * 16, turn * 16 + 16):
                    if (record, index) in want:
                        break
                    text = f"20260915\0{record}|negative={index}\0{attempt}"
                    at = int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) % (12_000 - 60 + 1)
                    k = int(record[1:])
                    share = lambda s: sum(c in "GC" for c in s) / len(s)
                    if all(free[at : at + 60]) and abs(share(whole[at : at + 60]) - share(whole[k * 50 : k * 50 + 60])) <= 0.1 + 1e-12:
                        want[record, index] = at
                        free[at : at + 60] = [False] * 60
    assert {(r.record_id, r.negative_index): r.start for r in got} == want
    everything = regions(spark, [("a", 0, 12_000)])
    with pytest.raises(RuntimeError, match="24 controls not matched"):
        sampling.matched_controls(positives, genome, everything, ratios=two, rounds=1)
    lost = sampling.matched_controls(positives, genome, everything, rounds=1, strict=False).collect()
    assert len(lost) == 8 + 80 and all(r.start is None for r in lost)
    pairs = sampling.negative_pairs(positives.withColumns({"start": F.lit(0), "end": F.lit(60)}), spark.createDataFrame(got)).collect()
    assert len(pairs) == 24 and len({r.negative_id for r in pairs}) == 24 and all(r.gc_delta <= 0.1 + 1e-9 for r in pairs)
    spans = sorted((r.start, r.end) for r in got)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    gc = lambda s: sum(c in "GC" for c in s) / len(s)
    for r in got:
        assert not (r.start < 3000 and 1000 < r.end)
        k = int(r.record_id[1:])
        assert abs(gc(whole[r.start : r.end]) - gc(whole[k * 50 : k * 50 + 60])) <= 0.1 + 1e-9


@pytest.mark.parametrize("size,share", [(60_000, 0.25), (5_000, 1.0)])
def test_waves_of_attempts_serve_as_the_whole_pass_does(spark, monkeypatch, size, share):
    """Roomy and crowded genomes: the same controls as with all attempts at once, from fewer reads."""
    rng = random.Random(size)
    pieces = [("a", k, "".join(rng.choice("ACGT") for _ in range(sampling.CHUNK))) for k in range(size // sampling.CHUNK)]
    genome = checkpointed(spark.createDataFrame(pieces, "chrom string, piece bigint, seq string"))
    whole = "".join(p[2] for p in pieces)
    positives = checkpointed(spark.createDataFrame([(f"p{k:02d}", "train" if k % 3 else "test", "a", whole[k * 50 : k * 50 + 60]) for k in range(40)], "record_id string, split string, chrom string, seq string"))
    forbidden = regions(spark, [("a", 1000, 2000)])
    reads, true = [], sampling.region_sequences
    monkeypatch.setattr(sampling, "region_sequences", lambda rows, store: reads.append(rows.count()) or true(rows, store))
    found, read = [], []
    for waves in (0, 10**9):
        monkeypatch.setattr(sampling, "WAVES", waves)
        reads.clear()
        rows = sampling.matched_controls(positives, genome, forbidden, tolerance=0.12, ratios={"train": 1, "test": 3}, rounds=2, strict=False).collect()
        found.append(sorted((r.record_id, r.negative_index, r.start or -1, -1 if r.attempt is None else r.attempt) for r in rows))
        read.append(sum(reads))
    assert found[0] == found[1] and len(found[0]) == 26 + 42 and read[0] < share * read[1]


def test_controls_of_all_splits_and_rounds_share_their_reads(spark, monkeypatch):
    rng = random.Random(5)
    pieces = [("a", k, "".join(rng.choice("ACGT") for _ in range(sampling.CHUNK))) for k in range(20)]
    genome = checkpointed(spark.createDataFrame(pieces, "chrom string, piece bigint, seq string"))
    positives = spark.createDataFrame([(f"p{k}", "train" if k % 2 else "test", "a", pieces[k][2][:60]) for k in range(6)], "record_id string, split string, chrom string, seq string")
    reads, true = [], sampling.region_sequences
    monkeypatch.setattr(sampling, "region_sequences", lambda rows, store: reads.append(1) or true(rows, store))
    monkeypatch.setattr(sampling, "WAVES", 0)
    got = sampling.matched_controls(positives, genome, regions(spark, []), tolerance=0.05, most_unknown=0.1, ratios={"train": 1, "test": 2}, rounds=3, strict=False)
    assert got.where("start is not null").count() == 9 and len(reads) <= 3


@pytest.mark.parametrize("within", [False, True])
def test_a_counted_genome_gives_what_its_letters_give(spark, monkeypatch, within):
    """Tiles of 2048 letters: regions over their ends, closed regions longer than a tile, lower case, other letters, a short last piece."""
    monkeypatch.setattr(sampling, "SPAN", 2048)
    rng = random.Random(6)
    text = {"a": "".join(rng.choice("ACGTacgtNx-") for _ in range(9500)), "b": "".join(rng.choice("ACGT") for _ in range(3000))}
    pieces = [(c, k, s[k * 1000 : k * 1000 + 1000]) for c, s in text.items() for k in range(-(-len(s) // 1000))]
    genome = spark.createDataFrame(pieces, "chrom string, piece bigint, seq string")
    asked = [(c, a, a + n) for c, s in text.items() for n in (1, 60, 701) for a in [rng.randrange(len(s) - n) for _ in range(60)]]
    closed = [("a", 100, 130), ("a", 110, 400), ("a", 2040, 2050), ("a", 3000, 5200), ("b", 0, 10)]
    allowed = [("a", 0, 4000), ("a", 4000, 9100), ("a", 500, 600), ("b", 1000, 2900)]
    free = {c: [not any(x == c and a <= k < b for x, a, b in closed) and (not within or any(x == c and a <= k < b for x, a, b in allowed)) for k in range(len(s))] for c, s in text.items()}
    want = {(c, a, b, sum(x in "ACGT" for x in text[c][a:b].upper()), sum(x in "GC" for x in text[c][a:b].upper())) for c, a, b in asked if all(free[c][a:b])}
    store = checkpointed(sampling.counted(genome, regions(spark, closed), regions(spark, allowed) if within else None, 701))
    got = sampling.region_sequences(regions(spark, asked), store).collect()
    assert {tuple(r) for r in got} == want and len(want) > 50
    with pytest.raises(Exception, match="leaves the genome"):
        sampling.region_sequences(regions(spark, [("b", 2950, 3001) if not within else ("c", 5, 9)]), store).collect()
    again = sampling.counted(genome.unionByName(genome.where("chrom = 'b' and piece = 1")), regions(spark, []), None, 701)
    assert sampling.region_sequences(regions(spark, [("b", 5, 900), ("b", 2000, 2700)]), again).count() == 2
    with pytest.raises(Exception, match="twice"):
        sampling.region_sequences(regions(spark, [("b", 990, 1001)]), again).collect()


@pytest.mark.parametrize("few", [0, 10**9])
def test_pass_in_order_by_rounds_and_as_a_stream(spark, few):
    rng = random.Random(8)
    rows = [((turn * 40 + key) * 5 + k, key, "ab"[key % 2], at := rng.randrange(400), at + rng.choice([5, 20, 60])) for turn in range(3) for key in range(40) for k in range(5)]
    held, served = [], set()
    for place, key, chrom, start, end in rows:
        if key not in served and not any(c == chrom and a < end and start < b for _, c, a, b in held):
            served.add(key)
            held.append((place, chrom, start, end))
    rng.shuffle(rows)
    proposals = spark.createDataFrame(rows, "place bigint, key_ bigint, chrom string, start bigint, end bigint").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sampling.first_fits(checkpointed(proposals), few).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.place, r.chrom, r.start, r.end) for r in got) == held and 15 < len(held) < 40


def test_many_proposals_of_a_chromosome_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_conflicts", None)
    n = 210_000
    rows = checkpointed(spark.range(n).selectExpr("id as place", "id div 3 as key_", "'a' as chrom", "(id * 7919 * 104729) % 4000000 as start", "(id * 7919 * 104729) % 4000000 + 9 as end"))
    free, served, want = bytearray(4_000_010), -1, []
    for place in range(n):
        at = place * 7919 * 104729 % 4_000_000
        if place // 3 != served and not any(free[at : at + 9]):
            free[at : at + 9], served = b"x" * 9, place // 3
            want.append(place)
    assert sorted(r.place for r in sampling.first_fits(rows).select("place").collect()) == want


def test_reads_fail_outside_the_genome_and_on_repeated_pieces(spark):
    genome = spark.createDataFrame([("a", 0, "A" * sampling.CHUNK), ("a", 1, "C" * 500)], "chrom string, piece int, seq string")
    ask = lambda rows, store=genome: sampling.region_sequences(regions(spark, rows), store).collect()
    assert [(r.start, r.seq) for r in ask([("a", 997, 1003)])] == [(997, "AAACCC")] and len(ask([("a", 0, 5), ("a", 0, 5)])) == 1
    for rows in ([("a", 1498, 1503)], [("a", 1999, 2003)], [("b", 0, 5)]):
        with pytest.raises(Exception, match="leaves the genome"):
            ask([("a", 0, 5), *rows])
    with pytest.raises(Exception, match="twice|leaves"):
        ask([("a", 997, 1003)], genome.unionByName(genome.limit(1)))
    with pytest.raises(ValueError, match="twice"):
        sampling.genome_store(genome.unionByName(genome.limit(1)), "genome_twice")
    with pytest.raises(ValueError, match="controls for each"):
        sampling.sample_negatives(regions(spark, []), genome, regions(spark, []), {"train": 2, "test": 10})


def test_a_genome_store_is_not_moved(spark, tmp_path):
    pieces = spark.createDataFrame([("a", k, "ACGT"[k % 4] * sampling.CHUNK) for k in range(40)], "chrom string, piece bigint, seq string")
    spark.sql("DROP TABLE IF EXISTS genome_pieces")
    try:
        store = sampling.genome_store(pieces, "genome_pieces", 4)
        found = sampling.region_sequences(regions(spark, [("a", k * 900, k * 900 + 30) for k in range(40)]).hint("shuffle_merge"), store.hint("merge"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("genome_pieces") :] if "genome_pieces" in plan else ""
        assert len(found.collect()) == 40 and "Bucketed: true" in plan and "SelectedBucketsCount" in scan
    finally:
        spark.sql("DROP TABLE IF EXISTS genome_pieces")


def test_records_of_evaluations_resume_and_keep_scores(spark, tmp_path):
    rng = np.random.default_rng(9)
    seqs = [(k, "".join(rng.choice(list("ACGT"), 25))) for k in range(60)]
    rows = lambda some: spark.createDataFrame(some, "doc_id bigint, seq string")
    motifs = spark.createDataFrame([(r, f"c{r % 2}", 75.0, rng.dirichlet([1] * 4, 5).tolist(), 30.0, 40) for r in range(4)], "run_id bigint, cohort string, signal_percent double, pwm array<array<double>>, sites double, primary_count int")
    catalogue = spark.createDataFrame([(k, rng.dirichlet([1] * 4, 5).tolist()) for k in range(6)], "target_id int, pwm array<array<double>>")
    back, path = dict.fromkeys("ACGT", 0.25), str(tmp_path / "scores")
    run = lambda which, **more: evaluation.evaluation_records(which, rows(seqs[:20]), rows(seqs[20:]), catalogue, back, 0, 0.5, 4, "p1", **more)
    plain = {r.run_id: r for r in evaluation.evaluated(motifs, rows(seqs[:20]), rows(seqs[20:]), back, 0, 0.5).collect()}
    first = checkpointed(run(motifs.where("run_id < 2"), score_path=path))
    rest = run(motifs, done=first.select("run_id", "protocol", "scoring_order", "pseudocount", "pwm"), score_path=path).collect()
    both = {r.run_id: r for r in [*first.collect(), *rest]}
    assert [r.run_id for r in sorted(rest)] == [2, 3] and sorted(both) == [0, 1, 2, 3]
    for k, r in both.items():
        assert (r.ap, r.auroc, r.positives, r.negatives) == (plain[k].ap, plain[k].auroc, 20, 40) and r.site_fraction == 0.75 and r.contamination_percent == 25
        assert [m.target_id for m in r.matches] == list(range(6)) and all(0 < m.p <= m.q + 1e-12 <= 1 + 1e-9 for m in r.matches)
    scores = spark.read.parquet(path).groupBy("cohort", "run_id").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    assert sorted(tuple(r) for r in scores) == [("c0", 0, 60, 20), ("c0", 2, 60, 20), ("c1", 1, 60, 20), ("c1", 3, 60, 20)]
    held = first.select("run_id", "protocol", "scoring_order", "pseudocount", "pwm")
    for other in (held.withColumn("protocol", F.lit("p2")), held.withColumn("pseudocount", F.lit(0.1)), held.withColumn("pwm", F.reverse("pwm"))):
        with pytest.raises(ValueError, match="another evaluation"):
            run(motifs, done=other)
    with pytest.raises(ValueError, match="overlap"):
        evaluation.evaluation_records(motifs, rows(seqs[:30]), rows(seqs[20:]), catalogue, back, 0, 0.5, 4, "p1")
    with pytest.raises(ValueError, match="twice"):
        run(motifs.unionByName(motifs))


def test_deep_overlap_groups_are_digested_as_streams(spark):
    """A group of more members than an Arrow batch, beside small ones: digests as by hand, whatever the batches."""
    deep = [("a", 0, 100_000, f"r{k:05d}", 1.0) for k in range(12_000)]
    small = [("b", k * 10, k * 10 + 5, f"s{k}", 1.0) for k in range(300)]
    df = spark.createDataFrame(deep + small, "chrom string, start bigint, end bigint, record_id string, score double")
    got = {(r.chrom, r.record_id): r.group_id for r in intervals.overlap_groups(df.repartition(5)).collect()}
    line = lambda rows: "grp_" + hashlib.sha256("\n".join("\t".join(map(str, r[:4])) for r in rows).encode()).hexdigest()[:16]
    assert len(got) == 12_300 and {got["a", r[3]] for r in deep} == {line(deep)} and all(got["b", r[3]] == line([r]) for r in small)
    plan = intervals.overlap_groups(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_settings_are_declared_and_never_inferred(spark):
    frame = lambda columns, *rows: spark.createDataFrame(list(rows), columns)
    factors, targets = frame("cohort string, factor string", ("c1", "f1"), ("c2", "f1"), ("c3", "f3")), frame("factor string, width int", ("f1", 19), ("f2", 8))
    ask = lambda cohorts, f=factors, t=targets: sorted(tuple(r) for r in cohorts_of(cohorts, f, t).select("cohort", "run", "factor", "width").collect())
    cohorts_of = lambda names, f, t: cohorts.with_settings(frame("cohort string, run int", *[(n, k) for k, n in enumerate(names)]), f, t)
    assert ask(["c1", "c2", "c1"]) == [("c1", 0, "f1", 19), ("c1", 2, "f1", 19), ("c2", 1, "f1", 19)]
    for names, message in ((["c9"], "cohort c9"), ([None], "cohort null"), (["c3"], "factor f3")):
        with pytest.raises(Exception, match=message):
            ask(names)
    with pytest.raises(ValueError, match="declared twice"):
        ask(["c1"], factors.unionByName(factors))
    with pytest.raises(ValueError, match="declared twice"):
        ask(["c1"], factors, targets.unionByName(targets))


def test_summaries_go_by_the_text_of_their_key(spark):
    rows = [("oops", 25.0, 19), ("oops", 100.0, 19), ("zoops", 5.0, 8), ("oops", 100.0, 8)]
    df = spark.createDataFrame(rows, "model string, level double, width int")
    assert [tuple(r) for r in df.orderBy(extensions.key_text("'model", "level", "width")).collect()] == sorted(rows, key=str)


def word_starts(codes, width, back):
    """Counts of words of codes [n, length] and the matrices that the best of them grow into."""
    windows = [row[j : j + width] for row in codes for j in range(codes.shape[1] - width + 1)]
    counts = np.bincount([int("".join(map(str, w)), 4) for w in windows if (w < 4).all()], minlength=4**width).astype(float)
    return [discovery._grown(counts, width, back, w) for w in discovery.start_words(counts, width, back, discovery.STARTS)]


def test_discovery_finds_a_planted_motif():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, (60, 50)).astype(np.int8)
    word = np.array([0, 2, 2, 1, 3, 0, 1, 1], np.int8)
    for i in range(60):
        at = rng.integers(0, 42)
        codes[i, at : at + 8] = word
    starts = [m for _, m in word_starts(codes, 8, np.full(4, 0.25))]
    pwm, sites, _ = discovery.expectation_maximisation(codes, starts, "oops", rounds=40)
    assert pwm.max(1).mean() > 0.8 and sites > 30


def test_discovery_takes_all_sequences(spark):
    """The same as the model in memory over all sequences, from the same start; sets of other lengths beside it."""
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), 30, p=[0.3, 0.2, 0.2, 0.29, 0.01])) for _ in range(2500)]
    for i in range(0, 2500, 2):
        at = rng.integers(0, 22)
        seqs[i] = seqs[i][:at] + "ACGTTGCA" + seqs[i][at + 8 :]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(seqs)] + [("b", i, x[: 20 - i % 3]) for i, x in enumerate(seqs[:40])] + [(None, 1, "ACGTACGTACGT"), (None, 2, "AC"), (None, 3, None)], "task string, doc_id long, seq string")
    codes = np.array([["ACGTN".index(c) for c in s] for s in seqs])
    letters = np.bincount(codes.ravel(), minlength=5)[:4]
    back = (letters + 1) / (letters.sum() + 4)
    start = max(word_starts(codes, 8, back), key=lambda x: x[0])[1]
    for model in ("zoops", "oops"):
        got = {r.task: r for r in discovery.discovered(df, 8, model).collect()}
        pwm, sites, score = discovery.expectation_maximisation(codes, [start], model)
        assert (got["a"].n, got["b"].n, got[None].n) == (2500, 40, 2)
        assert np.allclose(np.array(got["a"].pwm), pwm, atol=1e-6) and got["a"].sites == pytest.approx(sites, rel=1e-6) and got["a"].score == pytest.approx(score, rel=1e-6)
        assert "".join("ACGT"[k] for k in np.argmax(got["a"].pwm, 1)) == "ACGTTGCA" and got["a"].log10_evalue < -50
    with pytest.raises(ValueError, match="as long as"):
        discovery.discovered(df.where("task = 'b'"), 21)


def test_discovery_reads_blocks(spark, monkeypatch):
    """Rounds read a few blocks of many sequences, with long and empty ones and whatever the blocks the same result; letters of texts are alike in both ways."""
    rng = np.random.default_rng(5)
    rows = [(t, i, "".join(rng.choice(list("ACGTN"), int(n)))) for t in ("a", None) for i, n in enumerate([5000, 0, 7, *rng.integers(0, 60, 900)])]
    df = spark.createDataFrame(rows, "task string, doc_id long, seq string").coalesce(1)
    seen, over = [], discovery._over_sets
    monkeypatch.setattr(discovery, "_over_sets", lambda held, *more: (seen.append(held.count()), over(held, *more))[1])
    found = {r.task: r for r in discovery.discovered(df, 10).collect()}
    assert set(seen) == {2}
    monkeypatch.setattr(discovery, "BLOCK", 100)
    again = {r.task: r for r in discovery.discovered(df.repartition(3), 10).collect()}
    assert max(seen) > 200 and found.keys() == again.keys() == {"a", None}
    for task, r in found.items():
        assert r.n == again[task].n == 903 and np.allclose(r.pwm, again[task].pwm) and r.sites == pytest.approx(again[task].sites) and r.log10_evalue == pytest.approx(again[task].log10_evalue)
    codes = np.array([0, 1, 2, 3] * 700_000, np.int8)  # in parts that share letters: every window once
    parts = list(discovery._pieces(np.append(codes, np.int8(4)), np.array([len(codes)]), 9))
    assert len(parts) == 3 and sum(int(sequences._known(x, 10).sum()) for _, _, x in parts) == len(codes) - 9


def test_letters_are_alike_in_both_ways(spark):
    odd = ["Abc\t z\x0b!", "\u0130stanbul", "Kelvin \u212a", "\u0391\u03a3 \u03a3", "stra\u00dfe \u1e9e", "\U0001f600a b", "x\x1c\x85\u00a0\u2003z", "\ufb01 \u01c4 \u0149", "", None, "\x00aZ09"]
    df = spark.createDataFrame([(x,) for x in odd], "text string")
    for r in df.select("text", views.letters(F.col("text")).alias("sql"), views.letter_bytes(F.col("text")).cast("string").alias("bytes")).collect():
        assert r.sql == r.bytes, r.text


def test_weak_motifs_are_told_from_chance(spark):
    """A degenerate motif in one sequence of three is found and sure; sequences of single letters drawn alike hold none that is."""
    rng = np.random.default_rng(11)
    plain = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(1500)]
    pwm = np.full((10, 4), 0.1)
    pwm[np.arange(10), [0, 2, 1, 1, 3, 0, 2, 3, 3, 1]] = 0.7
    weak = []
    for i, s in enumerate(plain):
        at = rng.integers(0, 50)
        site = "".join(rng.choice(list("ACGT"), p=row) for row in pwm)
        weak.append(s[:at] + site + s[at + 10 :] if i % 3 == 0 else s)
    rows = [("weak", i, s) for i, s in enumerate(weak)] + [("none", i, s) for i, s in enumerate(plain)]
    found = {r.task: r for r in discovery.discovered(spark.createDataFrame(rows, "task string, doc_id long, seq string"), 10).collect()}
    got = np.array(found["weak"].pwm)
    match = max(sum(got[k - s].argmax() == pwm[k].argmax() for k in range(10) if 0 <= k - s < 10) for s in (-1, 0, 1))
    assert match >= 8 and found["weak"].log10_evalue < -3 < found["none"].log10_evalue


def test_chances_of_scores_and_counts():
    pwm, back = np.array(MATRIX[:4]), np.array([0.3, 0.2, 0.2, 0.3])
    low, above = discovery.score_tail(pwm, back)
    steps = np.round(np.log(pwm / back) / discovery.STEP).astype(int)
    every = [(sum(steps[j][c] for j, c in enumerate(w)), np.prod([back[c] for c in w])) for w in itertools.product(range(4), repeat=4)]
    for score, _ in every:
        assert above[int(score - low)] == pytest.approx(sum(p for s, p in every if s >= score))
    for k, n, p in ((3, 10, 0.1), (9, 10, 0.5), (10, 10, 0.2), (50, 1000, 0.03)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert discovery.log_binomial_tail(k, n, p) == pytest.approx(math.log(exact))
    assert discovery.log_binomial_tail(1, 10, 0.5) == 0.0


def test_compared_prefers_itself(spark):
    flip = [r[::-1] for r in MATRIX[::-1]]
    q = spark.createDataFrame([(1, flip)], "query_id int, pwm array<array<double>>")
    t = spark.createDataFrame([("x", MATRIX), ("y", [[0.25, 0.25, 0.3, 0.2]] * 4)], "target_id string, pwm array<array<double>>")
    best = comparison.compared(q, t, 3).orderBy(F.desc("score")).first()
    assert (best.target_id, best.strand, round(best.score, 9)) == ("x", "-", 1.0)


def test_tiles_share_the_draws_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TILE", 100)
    shares = [ranking._in_tile(1030, 11, t, [7, 3], 400) for t in range(11)]
    assert (sum(shares) == 1030).all()
    means = [x.mean() for x in shares]
    assert all(abs(m - 100) < 3 for m in means[:10]) and abs(means[10] - 30) < 2
    monkeypatch.undo()
    rng = np.random.default_rng(6)
    d = rng.normal(3, 2, 30_000)
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(d)] + [("b", 0, 5.0), (None, 0, 1.0), (None, 1, 3.0)], "g string, k bigint, d double")
    rows = [{r.g: tuple(r)[1:] for r in ranking.tiled_bootstrap_mean(df.repartition(n), ["g"], 4, 400).collect()} for n in (3, 7)]
    assert all(rows[0][g] == pytest.approx(rows[1][g]) for g in rows[0]) and rows[0].keys() == rows[1].keys()  # whatever the partitions
    n, mean, lower, upper = rows[0]["a"]
    half = 1.96 * d.std() / 30_000**0.5
    assert n == 30_000 and mean == pytest.approx(d.mean()) and abs(lower - (mean - half)) < 0.2 * half and abs(upper - (mean + half)) < 0.2 * half
    assert rows[0]["b"] == (1, 5.0, 5.0, 5.0)
    with pytest.raises(Exception, match="numbered"):
        ranking.tiled_bootstrap_mean(df.withColumn("k", F.col("k") + 1), ["g"], 4, 10).collect()


def test_tiled_bootstrap_reads_its_pairs_once(spark):
    """Pairs are computed once, draws are those of Generator.integers whatever the size of a tile, and null differences count as pairs only."""
    for n in (1, 2, 7, 64, 4096):
        d = np.random.default_rng(n).normal(size=n)
        times = np.random.default_rng(1).integers(0, 2 * n, 1500)
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([3, 5])))
        assert (ranking._drawn_sums(d, times, [3, 5]) == [d[rng.integers(0, n, t)].sum() for t in times]).all()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(9000, numPartitions=3).selectExpr("id as k", "cast(id % 10 as double) as d").mapInArrow(count, "k bigint, d double")
    n, mean, lower, upper = ranking.tiled_bootstrap_mean(df.withColumn("g", F.lit("x")), ["g"], 4, 200).select("n_pairs", "mean", "lower", "upper").first()
    assert (n, mean) == (9000, 4.5) and 4.3 < lower < 4.5 < upper < 4.7 and seen.value == 9000
    holes = spark.createDataFrame([("a", 0, 2.0), ("a", 1, None), ("a", 2, 4.0), ("b", 0, None)], "g string, k bigint, d double")
    assert {(r.g, r.n_pairs, r.mean) for r in ranking.tiled_bootstrap_mean(holes, ["g"], 4, 20).collect()} == {("a", 3, 3.0), ("b", 1, None)}


def test_replicates_read_rows_once(spark):
    """Ten thousand replicates of average precision: as by a loop, with joins and kernels that see no more rows than there are."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 40)), int(rng.integers(0, 6))) for _ in range(900)]
    df = spark.createDataFrame(rows, "label int, score double, k bigint").repartition(3)
    weights = rng.multinomial(6, [1 / 6] * 6, 10_000).T.astype(float)
    weights[:, 0] = 0
    got = {r.replicate: r.ap for r in ranking.replicate_precision(df, weights).collect()}
    assert len(got) == 10_000 and got[0] is None
    label, score, k = (np.array(c) for c in zip(*rows, strict=True))
    for r in (1, 2, 77, 9_999):
        w = weights[k, r]
        passed = {s: ((w * label)[score >= s].sum(), w[score >= s].sum()) for s in set(score)}
        want = sum((w * label)[score == s].sum() * p / n for s, (p, n) in passed.items() if n) / (w * label).sum()
        assert got[r] == pytest.approx(want)
    scored = df.select("label", F.col("k").alias("block"), "score", (-F.col("score")).alias("other"))
    found = extensions.block_bootstrap(scored, "block", "other", "score", 25, 5)
    assert found.count() == 25 and "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_match_significance_is_that_of_all_draws_of_columns(spark, monkeypatch):
    """p of every pair against an enumeration of all triples of catalogue columns, in one block of the catalogue and in several."""
    rng = np.random.default_rng(8)
    made = lambda width: rng.dirichlet([0.5] * 4, width).round(3)
    queries = {k: made(3) for k in range(3)}
    catalogue = {k: made(rng.integers(2, 5)) for k in range(7)}
    catalogue[5] = queries[1][::-1, ::-1]
    unit = lambda m: [comparison.unit_rows([r])[0] for r in m]
    bins = lambda a, b: int(np.floor(round(float(a @ b), 9) * 25 + 25.5))
    both = lambda m: (np.asarray(m), np.asarray(m)[::-1, ::-1])
    pool = [c for m in catalogue.values() for s in both(m) for c in unit(s)]
    want = {}
    for q, x in queries.items():
        scores = [[bins(a, b) for b in pool] for a in unit(x)]
        totals = {(lo, hi): np.array([sum(t) for t in itertools.product(*scores[lo:hi])]) for lo in range(3) for hi in range(lo + 2, 4)}
        for t, m in catalogue.items():
            least, tried = 1.0, 0
            for y in map(unit, both(m)):
                for shift in range(2 - len(y), 2):
                    lo, hi = max(0, shift), min(3, shift + len(y))
                    s = sum(bins(unit(x)[k], y[k - shift]) for k in range(lo, hi))
                    least, tried = min(least, float((totals[lo, hi] >= s).mean())), tried + 1
            want[q, t] = 1 - (1 - least) ** tried
    frame = lambda name, rows: spark.createDataFrame([(k, m.tolist()) for k, m in rows.items()], f"{name} int, pwm array<array<double>>")
    for block in (1000, 2):
        monkeypatch.setattr(comparison, "TARGETS", block)
        monkeypatch.setattr(comparison, "QUERIES", block)
        got = comparison.matches(frame("query_id", queries), frame("target_id", catalogue), 2).collect()
        assert len(got) == 21 and all(abs(r.p - want[r.query_id, r.target_id]) < 1e-9 and abs(r.e - 7 * r.p) < 1e-9 for r in got)
        best = min((r for r in got if r.query_id == 1), key=lambda r: r.p)
        assert (best.target_id, best.strand, best.shift, best.overlap) == (5, "-", 0, 3)
        for q in queries:
            ps = sorted(r.p for r in got if r.query_id == q)
            for r in (r for r in got if r.query_id == q):
                assert abs(r.q - min(1, min(p * 7 / (k + 1) for k, p in enumerate(ps) if p >= r.p))) < 1e-9
    assert comparison.matches(frame("query_id", queries), frame("target_id", {}), 2).count() == 0
    assert comparison.matches(frame("query_id", queries), frame("target_id", catalogue), 5).count() == 0


def test_compared_leaves_no_target_out(spark, monkeypatch):
    monkeypatch.setattr(comparison, "TARGETS", 100)
    q = spark.createDataFrame([(1, MATRIX), (2, MATRIX[:3])], "query_id int, pwm array<array<double>>")
    t = spark.range(1100).select(F.col("id").alias("target_id")).crossJoin(q.where("query_id = 1").select("pwm"))
    got = comparison.compared(q, t, 3).groupBy("query_id").agg(F.countDistinct("target_id").alias("n"), F.min("score").alias("s")).collect()
    assert {r.query_id: r.n for r in got} == {1: 1100, 2: 1100} and all(r.s > 0.99 for r in got)
    assert comparison.compared(q, t, 5).count() == 0


def test_logistic_models_against_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1, 40] + [3, -7]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3) * 1.5))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, c double, label double")
    frozen = diagnostics.fit_models(df, {"one": ["a"], "all": ["a", "b", "c"]})
    z = (x - x.mean(0)) / x.std(0)
    for name, columns in (("one", z[:, :1]), ("all", z)):
        m, w = np.c_[np.ones(300), columns], np.zeros(1 + columns.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-m @ w))
            ridge = np.diag([0.0] + [1.0] * columns.shape[1])
            w -= np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + ridge, m.T @ (p - y) + ridge @ w)
        assert frozen[name]["intercept"] == pytest.approx(w[0], abs=1e-4)
        assert frozen[name]["coefficients"][: len(w) - 1] == pytest.approx(list(w[1:]), abs=1e-4)
    assert frozen["all"]["scale"][2] == 1.0
    risk = [r.risk_one for r in diagnostics.predictions(df, frozen).collect()]
    assert all(0 < r < 1 for r in risk) and np.mean([(r > 0.5) == t for r, t in zip(risk, y, strict=True)]) > 0.6
    with pytest.raises(ValueError, match="both classes"):
        diagnostics.fit_models(df.where("label = 1"), {"one": ["a"]})
    with pytest.raises(ValueError, match="finite"):
        diagnostics.fit_models(df.withColumn("a", F.when(F.col("a") > 3, float("inf")).otherwise(F.col("a"))), {"one": ["a"]})


def test_split_as_one_job(spark, tmp_path):
    rng = random.Random(8)
    rows = [("a", s, s + rng.randint(5, 40), f"r{k}", rng.random()) for k, s in enumerate(rng.randrange(4000) for _ in range(120))]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, record_id string, score double")
    record = splits.write_split(df, str(tmp_path / "s"), 0.25, 3, 4)
    back = [x.split("\t") for x in spark.read.text(str(tmp_path / "s/manifest")).toPandas()["value"]]
    head, body = back[0], [x for x in back if x != back[0]]
    at = {c: head.index(c) for c in ("split", "chrom", "start", "end")}
    keys = [(x[at["split"]], x[at["chrom"]], int(x[at["start"]]), int(x[at["end"]])) for x in body]
    assert len(body) == 120 and sum(record["interval_counts"].values()) == 120 and record["cross_split_overlaps"] == 0
    assert [x[0] for x in keys].count("test") == record["interval_counts"]["test"]
    test, train = [k for k in keys if k[0] == "test"], [k for k in keys if k[0] == "train"]
    assert not any(a[2] < b[3] and b[2] < a[3] for a in test for b in train)
    with pytest.raises(Exception, match="already exists"):
        splits.write_split(df, str(tmp_path / "s"), 0.25, 3, 4)


def pair_runs(spark, change=None):
    rng = np.random.default_rng(2)
    rows = []
    for s in (1, 2):
        for level in (100.0, 0.0):
            for repeat in (0, 1):
                for m in ("oops", "zoops"):
                    pwm = rng.dirichlet(np.ones(4), 8).tolist()
                    rows.append({"cohort": "c", "sample": s, "signal_percent": level, "input_repeat": repeat, "order_repeat": 0, "meme_repeat": 0, "model": m, "run_id": f"{s}{level}{repeat}{m}", "input": f"{s}{level}{repeat}", "meme_seed": s, "discovery_background": "b", "background": "markov2", "motif_width": 8, "sample_size": 20, "ap": 0.5, "auroc": 0.6, "neg_log10_evalue": 3.0, "site_fraction": 0.4, "pwm": pwm})
    return spark.createDataFrame(change(rows) if change else rows)


def test_pairs_of_a_table_that_fills_no_whole_sample(spark, tmp_path):
    import os

    import duckdb

    from helixframe.queries import evaluation_queries

    for name in ("lineitem", "part"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 490").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for name, path in (("lineitem", "lineitem.parquet"), ("part", "part.parquet"), ("embeddings", "embeddings.parquet/*.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{path}'")
    got = evaluation_queries.paired_records(spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({evaluation_queries.SQL['paired_records']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect()) and len(want) == 24 * 5


def test_evaluations_of_another_protocol_are_refused(spark):
    made = lambda **new: spark.createDataFrame([("r", "r", "p1", 2, 0.5, 7, 7)], "run_id string, record_run_id string, protocol string, scoring_order int, pseudocount double, meme_seed int, motif_seed int").withColumns({k: F.lit(v) for k, v in new.items()})
    catalogue = lambda *rows: spark.createDataFrame(list(rows), "target_id string, pwm array<array<double>>")
    own, other = catalogue(("t", MATRIX)), catalogue(("t", MATRIX[:3]))
    ask = lambda runs, reference=own, declared=own, overlap=3: evaluation.checked_protocol(runs, "p1", (2, 0.5), reference, declared, "t", overlap)
    assert ask(made()).count() == 1
    for runs, message in ((made(scoring_order=1), "scoring order"), (made(pseudocount=0.1), "scoring order"), (made(protocol="p2"), "inconsistent"), (made(record_run_id="s"), "inconsistent"), (made(motif_seed=8), "seed")):
        with pytest.raises(ValueError, match=message):
            ask(runs)
    for reference, declared, overlap, message in ((own, other, 3, "differs"), (catalogue(("u", MATRIX)), own, 3, "target reference"), (own, own, 9, "overlap"), (own, own, 0, "overlap"), (own.limit(0), own, 3, "overlap")):
        with pytest.raises(ValueError, match=message):
            ask(made(), reference, declared, overlap)


def test_pairs_need_the_whole_grid_and_like_inputs(spark):
    grid = evaluation.planned_cells(spark.createDataFrame([(1,), (2,)], "sample int"), [100.0, 0.0])
    check = lambda change=None: evaluation.checked_cells(pair_runs(spark, change), grid, 8, 20)
    matches = spark.createDataFrame([("1100.00oops", "t", 9, 0.01, 1)], "run_id string, target string, match_overlap int, p double, place int")
    pairs = evaluation.paired_records(check(), matches, "t", 5, 0.05).collect()
    assert len(pairs) == 4 and all(0 <= r.disagreement <= 1 and 0 <= r.oops_resampling <= 1 for r in pairs)
    assert {(r["sample"], r.signal_percent): r.oops_weak_reference for r in pairs} == {(1, 100.0): 0, (1, 0.0): 1, (2, 100.0): 1, (2, 0.0): 1}
    assert all(r.weak_reference == 1 and r.weakest_log_confidence == pytest.approx(math.log(4)) for r in pairs)
    edit = lambda k, **new: lambda rows: [r | new if i == k else r for i, r in enumerate(rows)]
    for change, message in ((lambda rows: rows[1:], "not whole"), (lambda rows: [*rows, rows[0]], "twice"), (edit(0, order_repeat=1), "primary"), (edit(0, motif_width=9), "protocol"), (edit(0, cohort="d"), "one cohort")):
        with pytest.raises(ValueError, match=message):
            check(change)
    for change, message in ((edit(0, meme_seed=9), "same input"), (lambda rows: [r | {"input": "x"} for r in rows], "separate"), (lambda rows: [r | {"meme_seed": r["input_repeat"]} for r in rows], "same seed")):
        with pytest.raises(ValueError, match=message):
            evaluation.paired_records(check(change), matches, "t", 5, 0.05)
    assert evaluation.compact_pairs(pair_runs(spark, lambda rows: rows[1:])).count() == 3


def test_evaluation_refuses_shared_ids(spark):
    seqs = spark.createDataFrame([("x", "ACGTACGT"), ("y", "CCGGATAT")], "doc_id string, seq string")
    motif = spark.createDataFrame([("m", MATRIX, 10.0, 20)], "run_id string, pwm array<array<double>>, sites double, primary_count int")
    r = evaluation.evaluated(motif, seqs.where("doc_id = 'x'"), seqs.where("doc_id = 'y'"), dict.fromkeys("ACGT", 0.25), 0, 0.5).first()
    assert (r.positives, r.negatives, r.site_fraction) == (1, 1, 0.5) and r.ap in (0.5, 1.0) and r.auroc in (0.0, 1.0)
    with pytest.raises(ValueError, match="overlap"):
        evaluation.evaluated(motif, seqs, seqs, dict.fromkeys("ACGT", 0.25), 0, 0.5)


def test_cohorts(spark):
    pairs = spark.createDataFrame([("train", f"p{k}", 1, f"n{k}") for k in range(30)] + [("train", "p1", 2, "n9"), ("test", "p2", 1, "q")], "split string, positive_id string, negative_index int, negative_id string")
    seqs = lambda c: spark.createDataFrame([(f"{c}{k}", c.upper() * k) for k in range(1, 31)] + [(f"{c}0", "")], "id string, seq string")
    own = cohorts.training_pairs(pairs, seqs("p"), seqs("n"))
    assert own.count() == 30
    with pytest.raises(ValueError, match="two first pairs"):
        cohorts.training_pairs(pairs.union(pairs.limit(1)), seqs("p"), seqs("n"))
    with pytest.raises(ValueError, match="no sequence"):
        cohorts.training_pairs(pairs, seqs("p"), seqs("x"))
    seeds = {"sample": 1, "order": 2}
    rows = cohorts.cohort_records(own, 2, 2, 20, [100.0, 50.0, 0.0], seeds).collect()
    assert len(rows) == 2 * 2 * 3 * 20 and {r.source for r in rows if r.level == 100.0} == {"positive"}
    half = [r for r in rows if r.level == 50.0 and r["sample"] == 1 and r.input_repeat == 0]
    assert sorted(r.replacement_rank for r in half) == list(range(20)) and sum(r.source == "negative" for r in half) == 10
    for levels, message in (([50.0], "ends"), ([0.0, 0.0, 100.0], "differ"), ([0.0, 33.0, 100.0], "whole number")):
        with pytest.raises(ValueError, match=message):
            cohorts.cohort_records(own, 1, 1, 20, levels, seeds)
    with pytest.raises(ValueError, match="fewer"):
        cohorts.cohort_records(own, 1, 1, 31, [0.0, 100.0], seeds)
    frozen = spark.createDataFrame(rows)
    named = cohorts.cohort_sequences(frozen, seqs("p"), seqs("n"))
    assert named.count() == len(rows) and named.where("id not like 'slot\\_00%|%|%'").count() == 0
    by, ends = ["sample", "input_repeat"], named.where("level in (0, 100)")
    more = cohorts.refinement(frozen, by, [75.0], 20, ends, seqs("p"), seqs("n"))
    assert more.where("source = 'negative'").count() == 4 * 5
    with pytest.raises(ValueError, match="frozen endpoints"):
        cohorts.refinement(frozen, by, [75.0], 20, ends.where("slot > 0"), seqs("p"), seqs("n"))
    with pytest.raises(ValueError, match="permutation"):
        cohorts.checked_slots(frozen.where("level = 0 and slot <> 3"), by)


def test_pending_refuses_another_protocol(spark):
    plan = ladders.grid(spark, 2, 1, [50.0], ["oops"], {"sample": 1, "order": 2, "meme": 3})
    done = plan.where("sample = 1").select("run_id", "meme_seed", F.lit("complete").alias("status"))
    assert [r["sample"] for r in ladders.pending(plan, done).collect()] == [2]
    with pytest.raises(Exception, match="another protocol"):
        ladders.pending(plan, done.withColumn("meme_seed", F.lit(0).cast("bigint"))).collect()


def test_next_after(spark):
    values = [1.0, 0.5, 3.7, 1e300, -2.0, -1.5, 0.0, 0.1, 1 - 2**-53, -0.75, 123456.789]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", diagnostics.next_after(F.col("x")).alias("y")).collect()
    assert all(r.y == np.nextafter(r.x, np.inf) for r in got)
    one = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0)], "g string, label int, score double")
    assert diagnostics.thresholds(one, ["g"], 0.5).first().threshold == np.nextafter(2.0, np.inf)


def test_plans_and_their_runs(spark):
    seeds = {"sample": 1, "order": 2, "meme": 3}
    plan = ladders.grid(spark, 2, 2, [100.0, 50.0], ["oops", "zoops"], seeds)
    done = plan.limit(3).withColumn("status", F.lit("complete"))
    assert ladders.pending(plan, done).count() == 13
    with pytest.raises(RuntimeError, match="two results"):
        ladders.pending(plan, done.union(done.limit(1)))
    with pytest.raises(RuntimeError, match="another protocol"):
        ladders.pending(plan, done.withColumn("signal_percent", F.lit(7.0)))
    ids = [r.run_id for r in plan.limit(2).collect()]
    assert ladders.subset(plan, ids).count() == 2
    with pytest.raises(ValueError, match="no such runs: x"):
        ladders.subset(plan, [*ids, "x"])
    fine = ladders.fine_grid(spark, 1, [55.0, 60.0], ["oops"], seeds)
    assert {r.role for r in fine.collect()} == {"fine_signal_grid"} and fine.count() == 4
    again = ladders.with_seeds(plan, 3, 9)
    assert again.count() == 48 and again.select("run_id").distinct().count() == 48
    assert ladders.primary(again.withColumn("order_repeat", F.lit(0))).select(plan.columns).exceptAll(plan).count() == 0
    with pytest.raises(ValueError, match="four columns"):
        extensions.with_widths(plan, [3])
    a, b = plan.withColumn("cohort", F.lit("a")), plan.withColumn("cohort", F.lit("b"))
    assert ladders.concatenated([a, b]).count() == 32
    with pytest.raises(ValueError, match="one cohort"):
        ladders.concatenated([a, a])


def test_samples_drop_ranks_beyond_their_size_before_they_move(spark):
    pairs = spark.range(500).select(F.col("id").alias("positive_id"), (-F.col("id")).alias("negative_id"))
    plan = cohorts.sampled(pairs, 2, 1, 20, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pairs_are_counted_without_being_made(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TILE", 16)
    rng = random.Random(8)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randint(1, 30)) for s in (rng.randrange(120) for _ in range(n))]
    left, right = [*make(90), ("c", 0, 5)], [*make(70), ("c", 5, 9), ("d", 0, 3)]
    pairs = [(x[0], y[2] - y[1]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    got = {r.chrom: (r.n_pairs, r.positions) for r in intervals.pair_counts(regions(spark, left), regions(spark, right)).collect()}
    assert got == {c: (sum(p[0] == c for p in pairs), sum(p[1] for p in pairs if p[0] == c)) for c in "ab"}


def test_quantiles_are_those_of_the_sorted_values(spark):
    rng = random.Random(12)
    values = {"a": [float(rng.randrange(40)) for _ in range(101)], "b": [3.5], "c": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]] + [("d", None)], "g string, v double")
    shares = {"low": 0.025, "half": 0.5, "high": 0.975}
    got = {r.g: (r.low, r.half, r.high) for r in ranking.quantiles(rows, ["g"], "v", shares).collect()}
    assert got.pop("d") == (None, None, None)
    assert got == {g: pytest.approx(tuple(np.quantile(vs, list(shares.values())))) for g, vs in values.items()}


@pytest.mark.parametrize("width", [6, 9])
def test_sql_scan_looks_words_up_and_scores_as_the_kernel(spark, width):
    rng = random.Random(width)
    pwm = [[0.1, 0.2, 0.3, 0.4], [0.4, 0.1, 0.4, 0.1], [0.7, 0.1, 0.1, 0.1]] * (width // 3)
    seqs = spark.createDataFrame([(k, "ACGTACGTAC" + "".join(rng.choice("ACGTN") for _ in range(60))) for k in range(20)], "doc_id bigint, seq string")
    back = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
    rows = sequences.scan_sql(seqs.unionByName(spark.createDataFrame([(98, "ACG"), (99, "NNNNNNNNNNNN")], seqs.schema)), pwm, back)
    mine = {r.doc_id: r.max_log_odds for r in rows.collect()}
    theirs = {r.doc_id: r.max_log_odds for r in sequences.scan(seqs, spark.createDataFrame([(1, pwm)], "motif_id bigint, pwm array<array<double>>"), back, 0).collect()}
    assert mine == pytest.approx(theirs) and len(mine) == 20
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_scan_tells_the_best_motif_of_each_sequence(spark, monkeypatch):
    rng = random.Random(16)
    rows = spark.createDataFrame([(k, "".join(rng.choice("ACGT") for _ in range(40))) for k in range(30)], "doc_id bigint, seq string")
    one, two = [[0.7, 0.1, 0.1, 0.1]] * 3, [[0.1, 0.2, 0.3, 0.4]] * 3
    motifs = spark.createDataFrame([(2, one), (3, two), (1, one)], "motif_id bigint, pwm array<array<double>>")
    back = dict.fromkeys("ACGT", 0.25)
    every = sequences.scan(rows, motifs, back, 0).groupBy("doc_id").agg(F.max(F.struct("max_log_odds", "motif_id")).alias("b")).select("doc_id", "b.motif_id", "b.max_log_odds")
    want = sorted(map(tuple, every.collect()))
    for most in (sequences.BROADCAST_ROWS, 3):
        monkeypatch.setattr(sequences, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, sequences.scan(rows, motifs, back, 0, best_only=True).collect())) == want


def test_digests_of_packed_tiles_are_those_of_the_lines(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PACKED", 3)
    rng = random.Random(5)
    rows = [("a", rng.randrange(3), k // 7, k, f"line \u00e9 {k}") for k in range(60)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "chrom string, island bigint, tile_ bigint, k bigint, line string")
    want = {}
    for _, g, _, k, text in sorted(rows, key=lambda r: r[3]):
        want.setdefault(g, []).append(text)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for tile in (None, "tile_"):
            got = {r.island: r.digest for r in intervals.ordered_digests(lines, ["chrom", "island"], ["k"], tile).collect()}
            assert got == {g: hashlib.sha256("\n".join(x).encode()).hexdigest() for g, x in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_overlap_groups_pass_no_window_and_empty_ones_stay_alone(spark, monkeypatch):
    monkeypatch.setattr(intervals, "LARGE", 3)
    rng = random.Random(11)
    plain = [(rng.choice("ab"), s, s + rng.randint(1, 30)) for s in (rng.randrange(3000) for _ in range(150))]
    for extra in ([], [("a", 5000, 5000), ("a", 5000, 5000), ("a", 5000, 5010), ("b", 6000, 6000)]):
        rows = [(*r, f"r{k:03d}", float(rng.randrange(9))) for k, r in enumerate(plain + extra)]
        df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, record_id string, score double")
        wanted, reach, last = [], None, None
        for r in sorted(rows):
            if r[0] != last or r[1] >= reach:
                wanted.append([])
                reach = r[2]
            wanted[-1].append(r)
            last, reach = r[0], max(reach, r[2])
        told = lambda g: "grp_" + hashlib.sha256("\n".join("\t".join(map(str, r[:4])) for r in g).encode()).hexdigest()[:16]
        grouped = intervals.overlap_groups(df)
        assert {(r.record_id, r.group_id) for r in grouped.collect()} == {(r[3], told(g)) for g in wanted for r in g}
        assert extra or "Window" not in grouped._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, intervals.group_table(grouped).select("group_id", "start", "end", "n_intervals", "score").collect()))
        assert got == sorted((told(g), g[0][1], max(r[2] for r in g), len(g), float(np.median([r[4] for r in g]))) for g in wanted)


def test_leaks_are_looked_for_where_groups_of_both_splits_overlap(spark):
    make = lambda *rows: spark.createDataFrame([("a", *r) for r in rows], "chrom string, start bigint, end bigint, split string")
    assert not splits._may_leak(make((0, 10, "train"), (10, 20, "test"), (20, 30, "train"), (21, 25, "train")))
    assert splits._may_leak(make((0, 100, "train"), (5, 6, "train"), (99, 120, "test")))
    assert splits._may_leak(make((5, 9, "test"), (5, 6, "train")))


def test_scores_are_ranked_as_counts(spark, monkeypatch):
    """The ranking of evaluated motifs reads a row a run, label and score, and counts in it as rows do."""
    rng = random.Random(5)
    rows = [(k % 2, k, int(rng.random() < 0.4), float(rng.randrange(6))) for k in range(400)]
    df = spark.createDataFrame(rows, "run_id int, doc_id int, label int, score double")
    kept = []
    monkeypatch.setattr(evaluation, "checkpointed", lambda x: kept.append(x.count()) or checkpointed(x))
    got = {r.run_id: r for r in evaluation._metrics(df).collect()}
    ap, auc = ({r.run_id: r[1] for r in f(df, ["run_id"]).collect()} for f in (ranking.average_precision, ranking.auroc))
    assert kept == [len({(r[0], r[2], r[3]) for r in rows})]
    for run, r in got.items():
        assert (r.ap, r.auroc) == (pytest.approx(ap[run]), pytest.approx(auc[run]))
        assert (r.positives, r.negatives) == tuple(sum(x[2] == y for x in rows if x[0] == run) for y in (1, 0))
