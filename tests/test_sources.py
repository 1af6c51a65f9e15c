"""Readers and writers on small files."""

import pytest

from helixframe.sources import readers, sinks


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_bed(spark, tmp_path):
    rows = readers.read_bed(spark, put(tmp_path, "a.bed", "# c\n\nchr1\t5\t10\tx\t1.5\nchr2\t0\t3\n")).collect()
    assert [(r.chrom, r.start, r.end, r.peak_id, r.score, r.record_id) for r in rows] == [("chr1", 5, 10, "x", 1.5, "x|line=3"), ("chr2", 0, 3, ".", 0.0, ".|line=4")]
    with pytest.raises(ValueError, match="fewer than two"):
        readers.read_scored_bed(spark, put(tmp_path, "one.bed", "chr1\t5\t10\n"))
    with pytest.raises(Exception, match="line 1"):
        readers.read_bed(spark, put(tmp_path, "b.bed", "chr1\t5\t5\n")).collect()


def test_narrowpeak(spark, tmp_path):
    sizes = readers.read_sizes(spark, put(tmp_path, "s", "chr1 1000\nchr2\t500\n"))
    line = lambda c, a, b, name, off, q="2.5": "\t".join([c, str(a), str(b), name, "0", ".", "1", "1", q, str(off)])
    text = "\n".join([line("1", 100, 200, "p", 50), line("chr1", 0, 20, ".", 5), line("chr9", 1, 2, "q", 0), line("chr1", 10, 20, "r", 10), line("chr1", 300, 400, ".", 1)])
    rows = readers.read_narrowpeak(spark, put(tmp_path, "p", text + "\n"), sizes, 10, ["chr1"]).orderBy("source_line").collect()
    assert [r.outcome for r in rows] == ["kept", "boundary", "noneligible", "invalid_summit", "kept"]
    assert (rows[0].chrom, rows[0].start, rows[0].end, rows[4].peak_id) == ("chr1", 140, 161, "peak_5")
    with pytest.raises(Exception, match="duplicate"):
        readers.read_narrowpeak(spark, put(tmp_path, "d", line("1", 100, 200, "p", 50) + "\n" + line("1", 300, 400, "p", 50)), sizes, 10, ["chr1"]).collect()


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">a one\nACG\nTT\n>b\nGG\n")
    rows = sorted(map(tuple, readers.read_fasta(spark, path).collect()))
    assert rows == [("a", ">a one", "ACGTT"), ("b", ">b", "GG")]
    sinks.write_fasta(readers.read_fasta(spark, path), str(tmp_path / "out"))
    assert {r.id: r.seq for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()} == {"a": "ACGTT", "b": "GG"}
    with pytest.raises(Exception, match="already exists"):
        sinks.write_fasta(readers.read_fasta(spark, path), str(tmp_path / "out"))
    with pytest.raises(Exception, match="duplicate"):
        readers.read_fasta(spark, put(tmp_path, "c.fa", ">a\nA\n>a\nC\n")).collect()


def test_fasta_begins_with_a_header(spark, tmp_path):
    for k, text in enumerate(["junk\nACGT\n>a\nGG\n", "ACGT\n", "\n\njunk\n>a\nGG\n"]):
        with pytest.raises(ValueError, match="before the first header"):
            readers.read_fasta(spark, put(tmp_path, f"j{k}.fa", text))
    with pytest.raises(ValueError, match="empty FASTA"):
        readers.read_fasta(spark, put(tmp_path, "e.fa", "\n\n"))
    assert readers.read_fasta(spark, put(tmp_path, "b.fa", "\n>a\nGG\n")).first().seq == "GG"


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    text = "".join(f"line {k}\n" if k % 7 else "\n" for k in range(1, 5001))
    path = put(tmp_path, "many.txt", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers._lines(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        got = {r.number: r.line for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: f"line {k}" if k % 7 else "" for k in range(1, 5001)}


def test_matches_after_comments(spark, tmp_path):
    head = "\t".join(readers.MATCH_COLUMNS)
    row = "q\tt\t0\t0.01\t0.1\t0.2\t8\t+\n"
    rows = readers.read_matches(spark, put(tmp_path, "c", "# note\n\n" + head + "\n" + row * 2)).collect()
    assert [(r.p, r.place) for r in rows] == [(0.01, 4), (0.01, 5)]
    with pytest.raises(ValueError, match="missing match columns"):
        readers.read_matches(spark, put(tmp_path, "d", "a\tb\n" + row))
    with pytest.raises(ValueError, match="no header"):
        readers.read_matches(spark, put(tmp_path, "e", "# only\n"))
    with pytest.raises(Exception, match="invalid match in line 2"):
        readers.read_matches(spark, put(tmp_path, "f", head + "\n" + row.replace("0.01", "1.01"))).collect()


def test_reference_and_coarse_pairs(spark, tmp_path):
    text = "MEME version 4\n\nMOTIF m1 name\nletter-probability matrix: alength= 4 w= 2 nsites= 9\n 0.1 0.2 0.3 0.4\n 1 0 0 0\nMOTIF m2\nletter-probability matrix: w=1\n0.25 0.25 0.25 0.25\n"
    got = {r.motif_id: (r.width, r.pwm) for r in readers.read_reference(spark, put(tmp_path, "r.txt", text)).collect()}
    assert got == {"m1": (2, [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]]), "m2": (1, [[0.25] * 4])}
    with pytest.raises(Exception, match="invalid motif"):
        readers.read_reference(spark, put(tmp_path, "q.txt", text.replace("w= 2", "w= 3"))).collect()
    names = ["sample", "signal_percent", "disagreement", "oops_ap", "zoops_ap", "oops_neg_log10_evalue", "zoops_neg_log10_evalue", "oops_resampling", "zoops_resampling", "zoops_site_fraction"]
    path = put(tmp_path, "p.tsv", "\t".join(names) + "\n" + "\t".join("3 75 0.5 0.9 0.8 -2 1 0.1 0.2 0.3".split()) + "\n")
    r = readers.read_coarse_pairs(spark, path, "c").first()
    assert (r.cohort, r["sample"], r.signal, r.width, r.jsd, r.oops_conf) == ("c", 3, 75.0, 19, 0.5, 0.0) and r.zoops_conf == pytest.approx(0.6931471805599453)


def test_runs_must_be_the_planned_ones(spark, tmp_path):
    schema = "run_id string, status string, task struct<sample: int, model: string>"
    plan = spark.createDataFrame([(1, "oops"), (2, "oops")], "sample int, model string")
    folder = tmp_path / "runs"

    def result(name, sample, status="complete"):
        (folder / name).mkdir(parents=True, exist_ok=True)
        (folder / name / "result.json").write_text(f'{{"run_id": "{name}", "status": "{status}", "task": {{"sample": {sample}, "model": "oops"}}}}')

    result("a", 1)
    with pytest.raises(ValueError, match="no completed result"):
        readers.completed_runs(spark, str(folder), plan, schema)
    result("b", 2)
    assert readers.completed_runs(spark, str(folder), plan, schema).count() == 2
    result("c", 3)
    with pytest.raises(ValueError, match="not in the plan"):
        readers.completed_runs(spark, str(folder), plan, schema)
    result("c", 2, "failed")
    with pytest.raises(ValueError, match="not complete"):
        readers.completed_runs(spark, str(folder), plan, schema)


def test_records_and_failures(spark, tmp_path):
    sinks.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":[2],"b":1}'
    for message in ("first", "second"):
        sinks.write_failure(spark, str(tmp_path / "run"), {"sample": 1}, ValueError(message))
    assert '"message":"second"' in spark.read.text(str(tmp_path / "run/failure")).first()[0]
    sinks.write_uniform_background(spark, str(tmp_path / "u"))
    assert {r.word: r.freq for r in readers.read_markov(spark, str(tmp_path / "u"), 0).collect()} == dict.fromkeys("ACGT", 0.25)
    sinks.write_bed(spark.createDataFrame([("a", 1, 2, "p", 0.1)], "chrom string, start int, end int, peak_id string, score double"), str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first()[0] == "a\t1\t2\tp\t0.1"
    sinks.write_table(spark.range(6).selectExpr("id", "id % 2 as k"), str(tmp_path / "t"), by=["k"])
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 1").count() == 3
    assert readers.read_tsv(spark, put(tmp_path, "x.tsv", "a\tb\n1\tx\n")).first().b == "x"


def test_markov_and_matches(spark, tmp_path):
    text = "# order 0\nA 0.3\nC 0.2\nG 0.2\nT 0.3\n"
    assert readers.read_markov(spark, put(tmp_path, "m", text), 0).count() == 4
    with pytest.raises(Exception, match="words"):
        readers.read_markov(spark, put(tmp_path, "n", text), 1).collect()
    head = "\t".join(readers.MATCH_COLUMNS)
    rows = readers.read_matches(spark, put(tmp_path, "t", head + "\nq\tt\t0\t0.01\t0.1\t0.2\t8\t+\n\n# end\n")).collect()
    assert [(r.p, r.match_overlap, r.Target_ID) for r in rows] == [(0.01, 8, "t")]


def test_motif_xml(spark, tmp_path):
    row = "<alphabet_array><value letter_id='A'>0.7</value><value letter_id='C'>0.1</value><value letter_id='G'>0.1</value><value letter_id='T'>0.1</value></alphabet_array>"
    xml = f"<MEME><training_set primary_count='12'/><model><seed>7</seed></model><motifs><motif width='2' sites='10' e_value='1.2e-400'><probabilities><alphabet_matrix>{row}{row}</alphabet_matrix></probabilities></motif></motifs></MEME>"
    r = readers.read_motifs(spark, put(tmp_path, "m.xml", xml)).first()
    assert (r.width, r.sites, r.seed, r.primary_count, r.pwm) == (2, 10.0, 7, 12, [[0.7, 0.1, 0.1, 0.1]] * 2)
    assert r.neg_log10_evalue == pytest.approx(399.92081875)
    for k, (old, new) in enumerate([(">0.7<", ">0.8<"), ("<seed>7</seed>", ""), ("1.2e-400", "0"), (">0.7<", ">-0.7<")]):
        with pytest.raises(Exception, match="invalid motif"):
            readers.read_motifs(spark, put(tmp_path, f"bad{k}.xml", xml.replace(old, new))).collect()


def test_results_resume(spark, tmp_path):
    path = str(tmp_path / "r")
    assert not sinks.reusable(spark, path, {"seed": 1})
    sinks.write_result(spark.range(3), path, {"seed": 1})
    assert sinks.reusable(spark, path, {"seed": 1})
    with pytest.raises(RuntimeError, match="another protocol"):
        sinks.reusable(spark, path, {"seed": 2})
    shown = spark.createDataFrame([(100.0,), (0.1,), (123456.789,), (1e-7,)], "x double").select(sinks.twelve_digits("x").alias("t")).collect()
    assert [r.t for r in shown] == ["100", "0.1", "123456.789", "1e-07"]
    record = sinks.provenance(spark, [put(tmp_path, "f", "abc")]).first()
    assert (record.bytes, record.md5) == (3, "900150983cd24fb0d6963f7d28e17f72")


def test_files_are_hashed_as_streams_and_changes_refused(spark, tmp_path):
    import hashlib

    kinds = {"plain": b"a\nb\n", "open": b"a\n\nb", "empty": b"", "blank": b"\n", "two": b"\n\n", "binary": bytes(range(256)) * 50, "crlf": b"x\r\ny\r\n", "long": b"".join(b"line %d of many\n" % k for k in range(60_000))}
    for name, content in kinds.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # the long file comes in several parts
    try:
        got = {r.file.rsplit("/", 1)[1]: r for r in sinks.provenance(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.keys() == kinds.keys()
    for name, content in kinds.items():
        assert (got[name].bytes, got[name].sha256, got[name].md5) == (len(content), hashlib.sha256(content).hexdigest(), hashlib.md5(content).hexdigest()), name
    record = sinks.provenance_record(spark, [str(tmp_path / "plain"), str(tmp_path / "open")], {"order": 2}, "abc")
    assert record["commit"] == "abc" and record["versions"]["spark"] == spark.version and len(record["inputs"]) == 2
    sinks.checked_inputs(spark, record)
    (tmp_path / "open").write_bytes(b"a\n\nB")
    with pytest.raises(RuntimeError, match="open has changed"):
        sinks.checked_inputs(spark, record)


def test_narrowpeak_refuses_bad_peaks(spark, tmp_path):
    sizes = readers.read_sizes(spark, put(tmp_path, "s", "chr1 1000\n"))
    line = lambda a, b, off, q: "\t".join(["chr1", str(a), str(b), "p", "0", ".", "1", "1", q, str(off)])
    for k, bad in enumerate([line(990, 1001, 2, "1"), line(100, 200, 50, "-1"), line(100, 200, 50, "nan"), line(100, 200, 50, "x"), "chr1\t1\t2"]):
        with pytest.raises(Exception):
            readers.read_narrowpeak(spark, put(tmp_path, f"p{k}", bad + "\n"), sizes, 10, ["chr1"]).collect()


def test_compact_pairs_come_back_as_written(spark, tmp_path):
    rows = [("ctcf_fine", "c", 1, 95.0, 19, 0.1, 0.2, None, 0.5, 0.6, 1.0, 2.0, 0.4, 0.01, 0.02), ("ctcf_initial", "c", 2, 100.0, 19, 0.1, None, None, 0.5, 0.6, 1.0, 2.0, 0.4, 0.01, 0.02)]
    sinks.write_tsv(spark.createDataFrame(rows, readers.PAIR_SCHEMA), str(tmp_path / "pairs"))
    assert sorted(tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "pairs")).collect()) == sorted(rows, key=str)
    sinks.write_tsv(spark.createDataFrame([("other", *rows[0][1:])], readers.PAIR_SCHEMA), str(tmp_path / "odd"))
    with pytest.raises(Exception, match="unknown analysis other"):
        readers.read_pairs(spark, str(tmp_path / "odd")).collect()


def test_beds_tables_and_scores_are_written_whole(spark, tmp_path):
    beds = spark.createDataFrame([("chr1", 5, 10, "p", 1.5), ("chr2", 0, 3, "q", 1e-7), ("chr2", 7, 9, "r", 0.1 + 0.2)], "chrom string, start bigint, end bigint, peak_id string, score double")
    sinks.write_bed(beds, str(tmp_path / "bed"))
    back = {r.peak_id: (r.chrom, r.start, r.end, r.score) for r in readers.read_bed(spark, str(tmp_path / "bed")).collect()}
    assert back == {"p": ("chr1", 5, 10, 1.5), "q": ("chr2", 0, 3, 1e-7), "r": ("chr2", 7, 9, 0.3)}
    with pytest.raises(Exception, match="already exists"):
        sinks.write_bed(beds, str(tmp_path / "bed"))
    sinks.write_table(beds, str(tmp_path / "parts"), by=["chrom"])
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == ["chrom=chr1", "chrom=chr2"]
    sinks.write_table(beds.limit(1), str(tmp_path / "parts"), by=["chrom"], overwrite=True)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 1


def test_fasta_of_long_records_comes_in_pieces(spark, tmp_path):
    import random

    rng = random.Random(5)
    want, text = {}, ""
    for k, n in enumerate([1, 999, 1000, 0, 5003, 40_000]):
        seq = "".join(rng.choice("ACGTn") for _ in range(n))
        text += f">r{k} of many\n" + ("\n" if k == 2 else "")
        at = 0
        while at < n:
            step = rng.choice([1, 60, 61, 900, 2500])
            text += seq[at : at + step] + rng.choice(["\n", "\r\n", " \n"])
            at += step
        want |= {(f"r{k}", p): seq[p * 100 : p * 100 + 100].upper() for p in range(-(-n // 100))}
    path = put(tmp_path, "long.fa", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert {(r.id, r.piece): r.seq for r in readers.read_fasta_pieces(spark, path, 100).collect()} == want
        padded = readers.read_fasta_pieces(spark, path, 100, pad=True).collect()
        assert {len(r.seq) for r in padded} == {100} and len(padded) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k, (bad, message) in enumerate([("ACGT\n>a\nAC\n", "before the first"), (">a\nAC\n>a\nGT\n", "duplicate"), (">\nAC\n", "empty")]):
        with pytest.raises(ValueError, match=message):
            readers.read_fasta_pieces(spark, put(tmp_path, f"bad{k}.fa", bad))
