"""Readers of biological text formats into DataFrames with fixed schemas.

Lines are read by Spark's text source; a line number comes from the file's own order where a
rule needs one. What a format forbids fails with the line in the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.keyed import minus_log10
from helixframe.operators.intervals import aliases, valid
from helixframe.plans.materialise import broadcast_if_small, checkpointed
from helixframe.plans.running import running

#: Columns of a motif match table.
MATCH_COLUMNS = ("Query_ID", "Target_ID", "Optimal_offset", "p-value", "E-value", "q-value", "Overlap", "Orientation")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, number): number is the line's place in its file from 1.

    The text source splits files over tasks. Lines are counted by block of a file first; a
    line's number is then its place in the block and the lines of the blocks before it."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"))
    blocks = rows.groupBy("file_", "block_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = broadcast_if_small(blocks.select("file_", "block_", "first_", before.alias("before_")))
    return rows.join(placed, ["file_", "block_"]).select(F.regexp_replace("line", "\r$", "").alias("line"), (F.col("at_") - F.col("first_") + F.col("before_") + 1).alias("number"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).where((F.trim("line") != "") & ~F.col("line").rlike("^(#|track|browser)"))


def _required(ok: Column, message: str) -> Column:
    return F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit(message + " in line "), F.col("number").cast("string"))).isNull()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, peak_id (. if none), score (0 if none), record_id and source_line of a BED file."""
    f = F.split("line", "\t")
    named = F.when((F.size(f) >= 4) & (F.trim(F.get(f, 3)) != ""), F.trim(F.get(f, 3))).otherwise(".")
    score = F.when(F.size(f) >= 5, F.get(f, 4).try_cast("double")).otherwise(0.0)
    rows = _records(spark, path).select(F.trim(F.get(f, 0)).alias("chrom"), F.get(f, 1).try_cast("bigint").alias("start"), F.get(f, 2).try_cast("bigint").alias("end"), named.alias("peak_id"), score.alias("score"), "number")
    fine = valid(F.col("chrom"), F.col("start"), F.col("end")) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    checked = rows.where(_required(fine, "invalid interval"))
    return checked.withColumn("record_id", F.concat("peak_id", F.lit("|line="), F.col("number").cast("string"))).withColumnRenamed("number", "source_line")


def read_scored_bed(spark: SparkSession, path: str) -> DataFrame:
    """read_bed of a file that is to be split: two intervals at least."""
    rows = read_bed(spark, path)
    if rows.limit(2).count() < 2:
        raise ValueError(f"fewer than two intervals in {path}")
    return rows


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom and size of a chromosome size file; fails on a second row for a name or a size that is not positive."""
    f = F.split(F.trim("line"), r"\s+")
    rows = _records(spark, path).select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("bigint").alias("size"), "number").where(_required(F.col("size") > 0, "invalid size"))
    once = rows.groupBy("chrom").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    return once.where(F.assert_true(F.col("n") == 1, F.concat(F.lit("a second size for "), "chrom")).isNull()).select("chrom", "size")


def read_narrowpeak(spark: SparkSession, path: str, sizes: DataFrame, extension: int, eligible: list[str]) -> DataFrame:
    """Every peak with its window around the summit and an outcome: kept, noneligible, invalid_summit or boundary.

    chrom, start, end, peak_id, score, source_chrom, source_line, outcome. Fails on fewer than
    ten fields, a peak past its chromosome, a bad score, or an id that two kept rows share."""
    f = F.split("line", "\t")
    cut = _records(spark, path).where(_required(F.size(f) >= 10, "fewer than ten fields")).select(F.get(f, 0).alias("source_chrom"), F.get(f, 1).cast("bigint").alias("a"), F.get(f, 2).cast("bigint").alias("b"), F.get(f, 3).alias("name"), F.get(f, 8).try_cast("double").alias("score"), F.get(f, 9).cast("bigint").alias("offset"), "number")
    names = cut.select("source_chrom").distinct().select("source_chrom", F.posexplode(aliases(F.col("source_chrom"))).alias("k", "chrom"))
    best = names.join(sizes, "chrom").groupBy("source_chrom").agg(F.min_by(F.struct("chrom", "size"), "k").alias("m"))
    found = cut.join(best, "source_chrom", "left").withColumns({"chrom": F.col("m.chrom"), "size": F.col("m.size")}).drop("m")
    start, end = F.col("a") + F.col("offset") - extension, F.col("a") + F.col("offset") + extension + 1
    summit = (F.col("a") >= 0) & (F.col("b") > F.col("a")) & (F.col("offset") >= 0) & (F.col("offset") < F.col("b") - F.col("a"))
    outcome = F.when(F.coalesce(~F.col("chrom").isin(eligible), F.lit(True)), "noneligible").when(~summit, "invalid_summit").when((start < 0) | (end > F.col("size")), "boundary").otherwise("kept")
    rows = found.withColumns({"start": start, "end": end, "outcome": outcome, "peak_id": F.when(F.col("name").isin("", "."), F.concat(F.lit("peak_"), F.col("number").cast("string"))).otherwise(F.col("name"))})
    inside = F.col("outcome").isin("noneligible", "invalid_summit") | (F.col("b") <= F.col("size"))
    scored = (F.col("outcome") != "kept") | ((F.col("score") >= 0) & (F.col("score") != float("inf")) & ~F.isnan("score"))
    rows = rows.where(_required(inside, "peak past its chromosome")).where(_required(scored, "invalid score"))
    twice = rows.where("outcome = 'kept'").groupBy("peak_id").agg(F.count("*").alias("n_"))
    joined = rows.join(twice, "peak_id", "left").where(_required((F.col("outcome") != "kept") | (F.col("n_") == 1), "duplicate identifier"))
    return joined.select("chrom", "start", "end", "peak_id", "score", "source_chrom", F.col("number").alias("source_line"), "outcome")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, header and seq of a FASTA file, cut at > after a line's end; fails on text before the first record, an empty one or a repeated id."""
    read = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"\r", "").alias("value"), F.col("_metadata.file_path").alias("file_"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at_"))
    shown = F.col("value").rlike(r"\S")
    starts = read.groupBy("file_").agg(F.min_by(~shown | F.col("value").startswith(">"), "at_").alias("ok"), F.max(shown).alias("some")).collect()  # one row a file
    if not starts or not all(r["some"] for r in starts):
        raise ValueError(f"an empty FASTA file in {path}")
    if not all(r["ok"] for r in starts):
        raise ValueError(f"sequence before the first header in {path}")
    chunks = read.select("value")
    first = F.regexp_replace("value", r"^>", "")
    head = F.trim(F.regexp_extract(first, r"^([^\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(first, r"^[^\n]*\n?", ""), r"\s", "")
    rows = chunks.where(F.col("value").rlike(r"\S")).select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.concat(F.lit(">"), head).alias("header"), seq.alias("seq"))
    fine = F.assert_true((F.col("id") != "") & (F.col("seq") != ""), F.concat(F.lit("empty FASTA record "), "header"))
    rows = rows.where(fine.isNull())
    counts = rows.groupBy("id").agg(F.count("*").alias("n_")).where("n_ > 1").select("id")
    return rows.join(counts.withColumn("twice_", F.lit(True)), "id", "left").where(F.assert_true(F.col("twice_").isNull(), F.concat(F.lit("duplicate FASTA id "), "id")).isNull()).drop("twice_")


def read_fasta_pieces(spark: SparkSession, path: str, size: int = 1000, pad: bool = False) -> DataFrame:
    """id, piece and seq: the records of FASTA files in pieces of size letters, numbered from 0, upper case; the last one is shorter or, with pad, filled up with N.

    A record may be of any length: no row holds more than a line or a piece. Which record a line belongs to and
    how many letters stand before it follow from running counts over the blocks in which files are
    read. Fails on text before the first header, a header without an id, and an id that two headers have;
    a record without letters has no piece."""
    value = F.trim(F.regexp_replace("value", r"\s+$", ""))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"), value.alias("line")).where("line <> ''")
    head = F.col("line").startswith(">")
    counted = checkpointed(running(rows, ["file_"], "block_", [F.col("at_")], sums={"record_": head.cast("bigint")}))
    known = counted.withColumn("record_", F.col("record_") + head.cast("bigint"))
    if known.where("record_ = 0").limit(1).count():
        raise ValueError(f"sequence before the first header in {path}")
    names = known.where(head).select("file_", "record_", F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("id"))
    wrong = names.groupBy("id").count().where("count > 1 or id = ''").take(1)
    if wrong:
        raise ValueError(f"duplicate or empty FASTA id {wrong[0]['id']}")
    letters = known.where(~head).withColumn("line", F.upper(F.regexp_replace("line", r"\s", "")))
    placed = running(letters, ["file_", "record_"], "block_", [F.col("at_")], sums={"from_": F.length("line").cast("bigint")})
    spread = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("from_") / size), F.floor((F.col("from_") + F.length("line") - 1) / size))))
    first = F.greatest(F.lit(0), F.col("piece") * size - F.col("from_"))
    last = F.least(F.length("line").cast("bigint"), (F.col("piece") + 1) * size - F.col("from_"))
    part = F.col("line").substr((first + 1).cast("int"), (last - first).cast("int"))
    pieces = spread.groupBy("file_", "record_", "piece").agg(F.array_sort(F.collect_list(F.struct("from_", part.alias("part_")))).alias("parts_"))  # size letters
    seq = F.array_join(F.transform("parts_", lambda p: p["part_"]), "")
    return pieces.join(names, ["file_", "record_"]).select("id", "piece", (F.rpad(seq, size, "N") if pad else seq).alias("seq"))


def read_markov(spark: SparkSession, path: str, order: int) -> DataFrame:
    """word and freq of a background file; fails unless it has all words of 1 to order + 1 letters, each positive."""
    f = F.split(F.trim("line"), r"\s+")
    rows = _records(spark, path).select(F.upper(F.get(f, 0)).alias("word"), F.get(f, 1).try_cast("double").alias("freq"), "number")
    rows = rows.where(_required((F.col("freq") > 0) & ~F.col("word").rlike("[^ACGT]") & F.length("word").between(1, order + 1), "invalid background word")).select("word", "freq")
    wanted = sum(4**k for k in range(1, order + 2))
    total = rows.agg(F.countDistinct("word").alias("w"), F.count("*").alias("n"))
    fine = F.assert_true((F.col("w") == wanted) & (F.col("n") == wanted), F.lit(f"a background of order {order} has {wanted} words"))
    return rows.crossJoin(F.broadcast(total)).where(fine.isNull()).select("word", "freq")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """One row a motif file in XML: pwm, sites, e_value_text, neg_log10_evalue, width, seed, primary_count of its first motif."""
    x = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    first = "/MEME/motifs/motif[1]"
    values = F.expr(f"transform(xpath(value, '{first}/probabilities/alphabet_matrix/alphabet_array/value/text()'), v -> cast(v as double))")
    pwm = F.transform(F.sequence(F.lit(0), (F.size("flat") / 4).cast("int") - 1), lambda k: F.slice("flat", k * 4 + 1, 4))
    at = lambda name: F.expr(f"xpath_string(value, '{first}/@{name}')")
    rows = x.select("file", values.alias("flat"), at("width").cast("int").alias("width"), at("sites").cast("double").alias("sites"), at("e_value").alias("e_value_text"), F.expr("xpath_string(value, '/MEME/model/seed')").try_cast("bigint").alias("seed"), F.expr("xpath_string(value, '/MEME/training_set/@primary_count')").try_cast("int").alias("primary_count"))
    made = rows.withColumns({"pwm": pwm, "neg_log10_evalue": minus_log10(F.col("e_value_text"))})
    sums = F.forall("pwm", lambda r: (F.abs(F.aggregate(r, F.lit(0.0), lambda s, v: s + v) - 1) <= 1e-5) & F.forall(r, lambda v: (v >= 0) & ~F.isnan(v)))
    whole = (F.size("flat") == 4 * F.col("width")) & (F.col("sites") > 0) & F.col("seed").isNotNull() & F.col("neg_log10_evalue").isNotNull() & sums
    return made.where(F.assert_true(F.coalesce(whole, F.lit(False)), F.concat(F.lit("invalid motif in "), "file")).isNull()).drop("flat")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A motif match table: its eight columns as text, p and overlap as numbers, and place in the file."""
    lines = _lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    first = lines.agg(F.min_by("line", "number").alias("line"), F.min("number").alias("number")).first()
    if first["line"] is None:
        raise ValueError(f"no header in {path}")
    f = F.split("line", "\t")
    body = lines.where(F.col("number") > first["number"]).withColumn("names", F.array(*map(F.lit, first["line"].split("\t"))))
    if set(MATCH_COLUMNS) - set(first["line"].split("\t")):
        raise ValueError(f"missing match columns in {path}")
    pick = lambda name: F.get(f, F.array_position("names", name).cast("int") - 1)
    rows = body.select(*[pick(c).alias(c) for c in MATCH_COLUMNS], F.col("number").alias("place"), "number")
    p, e, q = (F.col(c).try_cast("double") for c in ("p-value", "E-value", "q-value"))
    fine = p.between(0, 1) & q.between(0, 1) & (e >= 0) & (e != float("inf"))
    return rows.where(_required(fine, "invalid match")).withColumns({"p": p, "match_overlap": F.col("Overlap").cast("int")}).drop("number")


#: The columns of a compact pair table, and its analyses.
PAIR_SCHEMA = "analysis string, cohort string, sample int, signal double, width int, jsd double, tv double, hellinger double, oops_ap double, zoops_ap double, oops_conf double, zoops_conf double, zoops_fraction double, oops_resampling double, zoops_resampling double"
ANALYSES = ("ctcf_initial", "ctcf_fine", "gabpa_width")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The compact pair table; an empty cell is null, an unknown analysis fails."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=PAIR_SCHEMA, nullValue="", mode="FAILFAST")
    known = F.col("analysis").isin(*ANALYSES)
    return rows.where(F.assert_true(F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown analysis "), F.coalesce("analysis", F.lit("")))).isNull())


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON result files of a path pattern as rows, with their file."""
    return spark.read.json(pattern, schema=schema, multiLine=True, mode="FAILFAST").withColumn("file", F.col("_metadata.file_path"))


def read_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header, all columns as text; a row of another number of fields fails."""
    return spark.read.csv(path, sep=sep, header=True, mode="FAILFAST", inferSchema=False)


def read_coarse_pairs(spark: SparkSession, path: str, cohort: str, width: int = 19) -> DataFrame:
    """A pair table of the first analysis in the columns of the compact one; confidences are log1p of what is positive of -log10 E."""
    number = lambda c: F.col(c).cast("double")
    conf = lambda m: F.log1p(F.greatest(F.lit(0.0), number(f"{m}_neg_log10_evalue"))).alias(f"{m}_conf")
    return read_tsv(spark, path).select(
        F.lit(cohort).alias("cohort"), F.col("sample").cast("int").alias("sample"), number("signal_percent").alias("signal"), F.lit(width).alias("width"), number("disagreement").alias("jsd"),
        number("oops_ap").alias("oops_ap"), number("zoops_ap").alias("zoops_ap"), conf("oops"), conf("zoops"),
        number("zoops_site_fraction").alias("zoops_fraction"), number("oops_resampling").alias("oops_resampling"), number("zoops_resampling").alias("zoops_resampling"),
    )


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """motif_id, width and pwm of the motifs of a minimal motif text; fails on a matrix of another width than stated."""
    text = spark.read.text(path, wholetext=True)  # a catalogue of a few motifs
    parts = text.select(F.explode(F.slice(F.split("value", r"(?m)^MOTIF\s+"), 2, 1 << 30)).alias("m"))
    rows = F.regexp_extract_all("m", F.lit(r"(?m)^\s*([0-9.eE+-]+\s+[0-9.eE+-]+\s+[0-9.eE+-]+\s+[0-9.eE+-]+)\s*$"), F.lit(1))
    pwm = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"\s+"), lambda v: v.cast("double")))
    found = parts.select(F.regexp_extract("m", r"^(\S+)", 1).alias("motif_id"), F.regexp_extract("m", r"\bw\s*=\s*(\d+)", 1).try_cast("int").alias("width"), pwm.alias("pwm"))
    return found.where(F.assert_true(F.coalesce(F.size("pwm") == F.col("width"), F.lit(False)), F.concat(F.lit("invalid motif "), "motif_id")).isNull())


def completed_runs(spark: SparkSession, folder: str, plan: DataFrame, schema: str) -> DataFrame:
    """The results of all runs of a plan (run_id and the other columns of a task), from FOLDER/*/result.json; schema has status and a task struct of the plan's columns.

    Fails where a run is missing, not complete, there twice, not planned, or of another task."""
    found = read_results(spark, f"{folder}/*/result.json", schema)
    keys = plan.columns
    done = found.select("status", *[F.col(f"task.{c}").alias(c) for c in keys])
    if done.where("status is distinct from 'complete'").limit(1).count():
        raise ValueError("a run is not complete")
    lost, other = plan.exceptAll(done.select(keys)), done.select(keys).exceptAll(plan)
    for what, rows in (("has no completed result", lost), ("is not in the plan", other)):
        first = rows.take(1)
        if first:
            raise ValueError(f"{first[0]} {what}")
    return found
