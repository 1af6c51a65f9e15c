"""Queries over intervals and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import views
from helixframe.operators import intervals as iv
from helixframe.operators import splits
from helixframe.views import SQL as V

FRACTION, SEED, BINS = 0.2, 42, 5


def interval_merge(spark, sf_dir):
    return iv.merged(views.intervals(spark, sf_dir))


def interval_groups(spark, sf_dir):
    return iv.group_table(iv.overlap_groups(views.intervals(spark, sf_dir)))


def interval_group_ids(spark, sf_dir):
    return iv.overlap_groups(views.intervals(spark, sf_dir)).select("record_id", "chrom", "start", "group_id")


def blacklist_anti(spark, sf_dir):
    return iv.overlapping(views.intervals(spark, sf_dir), views.mask(spark, sf_dir), keep=False).select("record_id", "chrom", "start", "end")


def blacklist_counts(spark, sf_dir):
    return iv.pair_counts(views.intervals(spark, sf_dir), views.mask(spark, sf_dir)).withColumnRenamed("positions", "mask_positions")


def mappable_contain(spark, sf_dir):
    return iv.contained(views.intervals(spark, sf_dir), views.mask(spark, sf_dir)).select("record_id", "chrom", "start", "end")


def chrom_alias_norm(spark, sf_dir):
    rows = views.intervals(spark, sf_dir)
    k = F.col("start") % 5
    odd = rows.withColumn("chrom", F.when(k == 0, F.concat(F.lit("chr"), "chrom")).when(k == 1, "M").when(k == 2, "zz").otherwise(F.col("chrom")))
    sizes = spark.createDataFrame([("AF", 900_000), ("NF", 900_000), ("NO", 1_000_000), ("chrM", 500_000), ("RF", 900_000), ("chrAF", 900_000)], "chrom string, size bigint")
    found = iv.on_chromosomes(odd, sizes)
    return found.groupBy("source_chrom", "chrom", "outcome").agg(F.count("*").alias("n"))


def _assigned(spark, sf_dir):
    return splits.assigned(iv.group_table(iv.overlap_groups(views.intervals(spark, sf_dir))), FRACTION, SEED, BINS)


def score_bins(spark, sf_dir):
    return splits.score_bins(iv.group_table(iv.overlap_groups(views.intervals(spark, sf_dir))), BINS).select("group_id", "bin")


def split_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("group_id", "chrom", "bin", "split")


def split_counts(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("split").agg(F.countDistinct("group_id").alias("n_groups"), F.sum("n_intervals").alias("n_intervals"))


def leak_audit(spark, sf_dir):
    """Of a split by record instead of by group: how many train intervals leak into test, by chromosome."""
    rows = views.intervals(spark, sf_dir).withColumn("split", F.when(F.conv(F.substring(F.md5("record_id"), 1, 2), 16, 10).cast("int") % 5 == 0, "test").otherwise("train"))
    return splits.leaks(rows).groupBy("chrom").agg(F.count("*").alias("n_leaks"))


QUERIES = {f.__name__: f for f in (interval_merge, interval_groups, interval_group_ids, blacklist_anti, blacklist_counts, mappable_contain, chrom_alias_norm, score_bins, split_assign, split_counts, leak_audit)}

_GROUPS = f"""WITH {V['intervals']},
 flagged AS (SELECT *, CASE WHEN start >= max("end") OVER (PARTITION BY chrom ORDER BY start, "end", record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v_intervals),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end", record_id ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
 ids AS (SELECT chrom, island, 'grp_' || substr(sha256(string_agg(concat_ws(chr(9), chrom, start, "end", record_id), chr(10) ORDER BY start, "end", record_id)), 1, 16) AS group_id,
   min(start) AS start, max("end") AS "end", count(*) AS n_intervals, median(score) AS score FROM numbered GROUP BY chrom, island)"""
_MERGED = """merged AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n_members FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
   SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM {0}))
 GROUP BY chrom, island)"""
_SPLIT = f"""{_GROUPS},
 binned AS (SELECT *, CAST(least(4, ((row_number() OVER (ORDER BY score, group_id)) - 1) * 5 // (SELECT count(*) FROM ids)) AS INT) AS bin FROM ids),
 strata AS (SELECT chrom, bin, count(*) AS members, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS base, count(*) * CAST(0.2 AS DOUBLE) - floor(count(*) * CAST(0.2 AS DOUBLE)) AS rest FROM binned GROUP BY chrom, bin),
 quota AS (SELECT chrom, bin, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, chrom, bin) <= (SELECT least(sum(members) - 1, greatest(1, floor(sum(members) * CAST(0.2 AS DOUBLE) + 0.5))) - sum(base) FROM strata) THEN 1 ELSE 0 END AS quota FROM strata),
 placed AS (SELECT b.*, row_number() OVER (PARTITION BY chrom, bin ORDER BY sha256('42' || chr(0) || group_id), group_id) AS place FROM binned b),
 split AS (SELECT p.*, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split FROM placed p JOIN quota USING (chrom, bin))"""

SQL = {
    "interval_merge": f"WITH {V['intervals']}, {_MERGED.format('v_intervals')} SELECT * FROM merged",
    "interval_groups": f"{_GROUPS} SELECT chrom, group_id, start, \"end\", n_intervals, score FROM ids",
    "interval_group_ids": f"{_GROUPS} SELECT record_id, n.chrom, n.start, group_id FROM numbered n JOIN ids i ON n.chrom = i.chrom AND n.island = i.island",
    "blacklist_anti": f"""WITH {V['intervals']}, {V['mask']}, {_MERGED.format('v_mask')}
SELECT record_id, chrom, start, "end" FROM v_intervals i WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.chrom = i.chrom AND m.start < i."end" AND i.start < m."end")""",
    "blacklist_counts": f"""WITH {V['intervals']}, {V['mask']} SELECT i.chrom, count(*) AS n_pairs, CAST(sum(m."end" - m.start) AS BIGINT) AS mask_positions
FROM v_intervals i JOIN v_mask m ON m.chrom = i.chrom AND m.start < i."end" AND i.start < m."end" GROUP BY i.chrom""",
    "mappable_contain": f"""WITH {V['intervals']}, {V['mask']}, {_MERGED.format('v_mask')}
SELECT record_id, chrom, start, "end" FROM v_intervals i WHERE EXISTS (SELECT 1 FROM merged m WHERE m.chrom = i.chrom AND m.start <= i.start AND m."end" >= i."end")""",
    "chrom_alias_norm": f"""WITH {V['intervals']}, odd AS (SELECT CASE start % 5 WHEN 0 THEN 'chr' || chrom WHEN 1 THEN 'M' WHEN 2 THEN 'zz' ELSE chrom END AS source_chrom, "end" AS e FROM v_intervals),
 sizes(name, size) AS (VALUES ('AF', 900000), ('NF', 900000), ('NO', 1000000), ('chrM', 500000), ('RF', 900000), ('chrAF', 900000)),
 cand AS (SELECT source_chrom, unnest([0, 1, 2, 3, 4]) AS k, unnest([source_chrom, regexp_replace(source_chrom, '^chr', ''), 'chr' || regexp_replace(source_chrom, '^chr', ''),
   CASE WHEN regexp_replace(source_chrom, '^chr', '') IN ('M', 'MT') THEN 'MT' END, CASE WHEN regexp_replace(source_chrom, '^chr', '') IN ('M', 'MT') THEN 'chrM' END]) AS name FROM (SELECT DISTINCT source_chrom FROM odd)),
 best AS (SELECT source_chrom, arg_min(name, k) AS chrom, arg_min(size, k) AS size FROM cand JOIN sizes USING (name) GROUP BY source_chrom)
SELECT o.source_chrom, b.chrom, CASE WHEN b.chrom IS NULL THEN 'unknown' WHEN e > size THEN 'beyond' WHEN b.chrom <> o.source_chrom THEN 'renamed' ELSE 'kept' END AS outcome, count(*) AS n
FROM odd o LEFT JOIN best b USING (source_chrom) GROUP BY ALL""",
    "score_bins": f"{_SPLIT} SELECT group_id, bin FROM binned",
    "split_assign": f"{_SPLIT} SELECT group_id, chrom, bin, split FROM split",
    "split_counts": f"{_SPLIT} SELECT split, count(DISTINCT group_id) AS n_groups, CAST(sum(n_intervals) AS BIGINT) AS n_intervals FROM split GROUP BY split",
    "leak_audit": f"""WITH {V['intervals']}, s AS (SELECT chrom, start, "end", CAST('0x' || substr(md5(record_id), 1, 2) AS INT) % 5 = 0 AS test FROM v_intervals)
SELECT chrom, count(*) AS n_leaks FROM s a WHERE NOT test AND EXISTS (SELECT 1 FROM s b WHERE b.test AND b.chrom = a.chrom AND b.start < a."end" AND a.start < b."end") GROUP BY chrom""",
}
