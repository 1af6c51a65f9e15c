"""Queries over sequences and position weight matrices."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from helixframe import views
from helixframe.functions import dna, keyed
from helixframe.operators import sequences as sq
from helixframe.views import SQL as V

#: An example motif of six columns, and letter frequencies.
MOTIF = [[0.05, 0.05, 0.85, 0.05], [0.4, 0.1, 0.1, 0.4], [0.02, 0.9, 0.04, 0.04], [0.3, 0.3, 0.15, 0.25], [0.1, 0.1, 0.1, 0.7], [0.55, 0.15, 0.15, 0.15]]
LETTERS = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}


def _scanned(spark, sf_dir, width):
    """The windows that a motif of width columns can score, each with what sites that begin in it need of the next one; window_id as doc_id."""
    return views.sequences(spark, sf_dir, width - 1).where(F.col("seq").rlike(f"[ACGT]{{{width}}}")).select(F.col("window_id").alias("doc_id"), "seq")


def gc_n_fraction(spark, sf_dir):
    return views.sequences(spark, sf_dir).select("doc_id", "k", F.round(dna.gc_fraction(F.col("seq")), 9).alias("gc"), F.round(dna.n_fraction(F.col("seq")), 9).alias("n"))


def revcomp(spark, sf_dir):
    return views.sequences(spark, sf_dir).select("doc_id", "k", dna.reverse_complement(F.col("seq")).alias("rc"))


def hash_start(spark, sf_dir):
    rows = views.intervals(spark, sf_dir)
    return rows.select("record_id", keyed.keyed_start(20260916, F.col("record_id"), F.lit(3), F.lit(1_000_000)).alias("start"))


def kmer_freq(spark, sf_dir):
    return sq.kmer_counts(views.wholes(spark, sf_dir), 3)


def markov_table(spark, sf_dir):
    return sq.markov_table(views.wholes(spark, sf_dir), 2).select("word", "k", F.round("freq", 9).alias("freq"))


def pwm_pseudocount(spark, sf_dir):
    rows = views.matrices(spark, sf_dir).select("vec_id", dna.with_pseudocount(F.col("pwm"), F.lit(20.0), 0.5).alias("pwm"))
    flat = rows.select("vec_id", F.posexplode("pwm").alias("k", "r"))
    return flat.select("vec_id", "k", *[F.round(F.element_at("r", j + 1), 9).alias(b) for j, b in enumerate("acgt")])


def pwm_scan_sql(spark, sf_dir):
    found = sq.scan_sql(_scanned(spark, sf_dir, len(MOTIF)), MOTIF, LETTERS)
    return found.select(F.col("doc_id").alias("window_id"), F.round("max_log_odds", 6).alias("max_log_odds"))


def pwm_scan_arrow(spark, sf_dir):
    motifs = spark.createDataFrame([(1, MOTIF)], "motif_id bigint, pwm array<array<double>>")
    return sq.scan(_scanned(spark, sf_dir, len(MOTIF)), motifs, LETTERS, 0).select(F.col("doc_id").alias("window_id"), F.round("max_log_odds", 6).alias("max_log_odds"))


def pwm_scan_markov(spark, sf_dir):
    """The mean matrix of each label against all windows that it can score, with a second-order background learnt from the whole texts: the best label of each."""
    seqs = _scanned(spark, sf_dir, 16)
    background = {r["word"]: r["freq"] for r in sq.markov_table(views.wholes(spark, sf_dir), 2).collect()}  # 84 words
    flat = views.matrices(spark, sf_dir).select(F.col("label").cast("bigint").alias("motif_id"), F.posexplode(F.flatten("pwm")).alias("at", "p"))
    means = flat.groupBy("motif_id", "at").agg(F.avg("p").alias("p")).groupBy("motif_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("v"))  # 64 numbers a label
    motifs = means.select("motif_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4)).alias("pwm"))
    best = sq.scan(seqs, motifs, background, 2, best_only=True)
    return best.select(F.col("doc_id").alias("window_id"), "motif_id", F.round("max_log_odds", 6).alias("max_log_odds"))


def _distance(metric, spark, sf_dir):
    m = views.matrices(spark, sf_dir)
    pair = F.floor(F.col("vec_id") / 2)
    left = m.where("vec_id % 2 = 0").select(pair.alias("pair"), F.col("pwm").alias("a"))
    right = m.where("vec_id % 2 = 1").select(pair.alias("pair"), F.slice("pwm", 1, 15).alias("b"))
    found = sq.motif_distances(left.join(right, "pair"), metric)
    return found.select("pair", F.round("distance", 9).alias("distance"), "shift", "strand", "overlap")


QUERIES = {f.__name__: f for f in (gc_n_fraction, revcomp, hash_start, kmer_freq, markov_table, pwm_pseudocount, pwm_scan_sql, pwm_scan_arrow, pwm_scan_markov)}
QUERIES |= {f"pwm_dist_{m}": partial(_distance, m) for m in ("jsd", "tv", "hellinger")}


def _case(j: str, matrix: list[list[float]]) -> str:
    rows = []
    for k, row in enumerate(matrix):
        for base, p in zip("ACGT", row, strict=True):
            rows.append(f"WHEN {j} = {k} AND b = '{base}' THEN ln(CAST({p} AS DOUBLE)) - ln(CAST({LETTERS[base]} AS DOUBLE))")
    return "CASE " + " ".join(rows) + " END"


_WORDS = "SELECT substr(whole, i, {k}) AS word FROM (SELECT whole, unnest(range(1, length(whole) + 2 - {k})) AS i FROM v_letters)"
_SCAN = f"""WITH {V['scan_windows']}, words AS (SELECT window_id, i, substr(seq, i, 6) AS word FROM v_sequences, (SELECT unnest(range(1, 202)) AS i) WHERE i <= length(seq) - 5),
 letters AS (SELECT window_id, i, j, substr(word, j + 1, 1) AS b FROM words, (SELECT unnest(range(6)) AS j) WHERE NOT regexp_matches(word, '[^ACGT]')),
 odds AS (SELECT window_id, i, greatest(sum({_case('j', MOTIF)}), sum({_case('j', [r[::-1] for r in MOTIF[::-1]])})) AS s FROM letters GROUP BY window_id, i)
SELECT window_id, round(max(s), 6) AS max_log_odds FROM odds GROUP BY window_id"""
_COLUMN = {
    "tv": "(abs(x.a - y.a) + abs(x.c - y.c) + abs(x.g - y.g) + abs(x.t - y.t)) / 2",
    "hellinger": "sqrt((power(sqrt(x.a) - sqrt(y.a), 2) + power(sqrt(x.c) - sqrt(y.c), 2) + power(sqrt(x.g) - sqrt(y.g), 2) + power(sqrt(x.t) - sqrt(y.t), 2)) / 2)",
    "jsd": "(" + " + ".join(f"CASE WHEN {u}.{b} > 0 THEN {u}.{b} * log2({u}.{b} / ((x.{b} + y.{b}) / 2)) ELSE 0 END" for b in "acgt" for u in "xy") + ") / 2",
}


def _distance_sql(metric: str) -> str:
    return f"""WITH {V['matrices']},
 lft AS (SELECT vec_id // 2 AS pair, k, a, c, g, t FROM v_pwm WHERE vec_id % 2 = 0),
 plus AS (SELECT vec_id // 2 AS pair, k, a, c, g, t, '+' AS strand FROM v_pwm WHERE vec_id % 2 = 1 AND k < 15),
 rgt AS (SELECT * FROM plus UNION ALL SELECT pair, 14 - k, t, g, c, a, '-' FROM plus),
 shifts AS (SELECT unnest(range(-2, 4)) AS shift),
 scored AS (SELECT x.pair, strand, shift, CAST(count(*) AS INT) AS overlap, (sum({_COLUMN[metric]}) + 31 - 2 * count(*)) / (31 - count(*)) AS score
  FROM lft x JOIN rgt y ON x.pair = y.pair JOIN shifts ON x.k = y.k + shift GROUP BY x.pair, strand, shift)
SELECT pair, round(greatest(0.0, least(1.0, score)), 9) AS distance, CAST(shift AS INT) AS shift, strand, overlap FROM scored QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score, strand, shift) = 1"""


_MARKOV = " UNION ALL ".join(
    f"""SELECT w.word, {k} AS k, round((coalesce(n, 0) + 0.1 / {4**k}) / ((SELECT count(*) FROM w{k}) + 0.1), 9) AS freq
 FROM (SELECT {' || '.join(f'{c}.b' for c in 'xyz'[:k])} AS word FROM {', '.join(f'letters {c}' for c in 'xyz'[:k])}) w LEFT JOIN (SELECT word, count(*) AS n FROM w{k} GROUP BY word) c USING (word)"""
    for k in (1, 2, 3)
)
SQL = {
    "gc_n_fraction": f"""WITH {V['sequences']}, n AS (SELECT doc_id, k, length(seq) AS size, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS known, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM v_sequences)
SELECT doc_id, k, round(CASE WHEN known = 0 THEN 0.0 ELSE CAST(gc AS DOUBLE) / known END, 9) AS gc, round(CAST(size - known AS DOUBLE) / size, 9) AS n FROM n""",
    "revcomp": f"WITH {V['sequences']} SELECT doc_id, k, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM v_sequences",
    "hash_start": f"WITH {V['intervals']} SELECT record_id, CAST(CAST('0x' || substr(sha256('20260916' || chr(0) || record_id || chr(0) || '3'), 1, 16) AS UBIGINT) % 1000001 AS BIGINT) AS start FROM v_intervals",
    "kmer_freq": f"WITH {V['sequences']}, w AS ({_WORDS.format(k=3)}) SELECT word, count(*) AS n FROM w WHERE NOT regexp_matches(word, '[^ACGT]') GROUP BY word",
    "markov_table": f"WITH {V['sequences']}, letters AS (SELECT unnest(['A','C','G','T']) AS b), " + ", ".join(f"w{k} AS (SELECT word FROM ({_WORDS.format(k=k)}) WHERE NOT regexp_matches(word, '[^ACGT]'))" for k in (1, 2, 3)) + f" {_MARKOV}",
    "pwm_pseudocount": f"WITH {V['matrices']} SELECT vec_id, CAST(k AS INT) AS k, " + ", ".join(f"round(({b} * 20 + 0.5) / 22, 9) AS {b}" for b in "acgt") + " FROM v_pwm",
    "pwm_scan_sql": _SCAN,
    "pwm_scan_arrow": _SCAN,
} | {f"pwm_dist_{m}": _distance_sql(m) for m in _COLUMN}
