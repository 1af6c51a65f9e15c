"""Periodic runs, phrase collocations and line deduplication against brute force, at their edges, and their queries against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import collocations, line_dedup, periodic_runs, queries, sql_twins
from helixframe.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# periodic runs


def brute_runs(t, least):
    got = {}
    for q in range(1, len(t) // 3 + 1):
        i = 0
        while i < len(t) - q:
            j = i
            while j < len(t) - q and t[j] == t[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                got.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in got.items())


def periodic_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 4)):
        letters = rng.choice([1, 2, 3, 20])
        t = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(1, 12)
            unit = [rng.randrange(letters) for _ in range(p)]
            at = rng.randint(0, len(t))
            t[at:at] = (unit * rng.randint(2, 9))[: -rng.randint(1, p)]
        texts.append(np.array(t, np.int64))
    return texts


def test_extensions_of_the_grammar_are_exact():
    rng = random.Random(1)
    for _ in range(60):
        t = np.concatenate([*periodic_texts(rng), [999, 1000]]).astype(np.int64)
        grammar = Grammar(t)
        i, j = (np.array([rng.randrange(len(t)) for _ in range(150)]) for _ in range(2))
        i, j = i[i != j], j[i != j]
        for a, b, ahead, behind in zip(i.tolist(), j.tolist(), grammar.extensions(i, j).tolist(), grammar.extensions(i, j, back=True).tolist(), strict=True):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert k == ahead
            k = 0
            while min(a, b) > k and t[a - k - 1] == t[b - k - 1]:
                k += 1
            assert k == behind


@pytest.mark.parametrize("places", [1 << 20, 50])
def test_runs_are_those_of_brute_force(monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "PLACES", places)
    rng = random.Random(places)
    for _ in range(150):
        texts, least = periodic_texts(rng), rng.choice([24, 24, 12, 6])
        for t, found in zip(texts, periodic_runs.find_runs(texts, least), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute_runs(t.tolist(), least)


def test_run_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {}
    for doc_id, text in rows_of(docs):
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words, 24)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = (None,) * 4
        for s, k, q in runs:
            if best[0] is None or k * best[2] > best[1] * q:
                best = (s, k, q, 1000 * k // q)
        told = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2])))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[doc_id] = (len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
    got = {r[0]: r[1:] for r in rows_of(queries.op11_periodic_runs(spark, SF))}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 10


def test_texts_are_grouped_by_words(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 50)
    groups = list(periodic_runs._grouped([[b"w"] * n for n in (30, 20, 1, 200, 0, 0, 50)]))
    assert [[len(w) for w in g] for g in groups] == [[30, 20], [1], [200], [0, 0, 50]]


def test_runs_at_the_edges(spark):
    loop = "a b c " * 12
    rows = [(1, None, "x"), (2, "", None), (3, " \n\t", "y"), (4, loop, "z"), (4, loop, "z"), (None, loop, None), (5, "w" * 100_000 + " " + loop + "v " * 30, "q"), (6, "été x " * 30, "u")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, RUNS string")
    out = periodic_runs.with_runs(docs)
    assert out.columns == ["doc_id", "RUNS", "text", "runs_"]
    got = [(r.doc_id, r.RUNS, r.text, [tuple(x) for x in r.runs_]) for r in out.collect()]
    assert got == [
        (1, "x", "", []), (2, None, "", []), (3, "y", "", []), (4, "z", "a b c", [(0, 36, 3)]), (4, "z", "a b c", [(0, 36, 3)]), (None, None, "a b c", [(0, 36, 3)]),
        (5, "q", "w" * 100_000 + " a b c v", [(1, 36, 3), (37, 30, 1)]), (6, "u", "été x", [(0, 30, 1)]),
    ]
    assert periodic_runs.with_runs(docs.limit(0)).collect() == []
    best = spark.createDataFrame([([(0, 30, 10), (5, 24, 8), (9, 40, 13)],), ([],)], f"runs array<{periodic_runs.RUN}>").select(periodic_runs.strongest(F.col("runs")).alias("b")).collect()
    assert tuple(best[0].b) == (9, 40, 13) and best[1].b is None


# phrases


def brute_phrases(rows, minimum, limit, percent):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= minimum}
        found = []
        for p, a in cand.items():
            inside = any(len(o) > len(p) and 100 * b >= percent * a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in cand.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def chatter(rng, n):
    words = ["the", "Of", "in", "été", "naïve", "x", "b2", "\U0001f600", "|", "a"]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w += rng.choice([["New", "york", "city"], ["of", "the", "in", "a", "x"], ["b2"] * 6])
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ""]) for x in w)
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([text, text, text.upper(), None]) if rng.random() < 0.2 else text))
    return out


def test_multikey_quicksort_counts_equal_parts():
    rng = np.random.default_rng(3)
    for minimum in (1, 4, 30):
        columns = [rng.integers(0, 4, 500) for _ in range(4)]
        weights = rng.integers(1, 4, 500)
        want = Counter()
        for row in range(500):
            word = [int(c[row]) for c in columns]
            for k in range(1, 5):
                if 0 in word[:k]:
                    break
                want[tuple(word[:k])] += int(weights[row])
        got = {tuple(int(c[row]) for c in columns[:depth]): count for depth, row, count in collocations.quicksorted(columns, weights, minimum)}
        assert got == {p: n for p, n in want.items() if n >= minimum}
    assert list(collocations.quicksorted([np.zeros(0, np.int64)], np.zeros(0, np.int64), 1)) == []


def test_long_texts_are_numbered_in_segments(monkeypatch):
    text = " ".join(t for _, t in chatter(random.Random(2), 80) if t).encode()
    whole = collocations._Words("en", 0)
    whole.take(text)
    monkeypatch.setattr(collocations, "SEGMENT", 30)
    parts = collocations._Words("en", 0)
    parts.take(text)
    assert len(parts.held) > 20 and (whole.emptied()[0] == parts.emptied()[0]).all() and (whole.ids == parts.ids).all()


@pytest.mark.parametrize("minimum,percent,route", [(5, 100, 1 << 18), (8, 80, 3), (2, 100, 1)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, minimum, percent, route):
    monkeypatch.setattr(collocations, "ROUTE_ROWS", route)  # few rows a route: leading words are parted further
    rows = chatter(random.Random(minimum), 150)
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n int").repartition(3)
    want = brute_phrases(rows, minimum, 50, percent)
    assert sorted(rows_of(collocations.collocations(docs, minimum, 50, percent))) == want and len(want) > 20


def test_phrase_numbers_with_two_words_are_drawn_anew(spark, monkeypatch):
    rows = [("en", "ab cd ef gh. ab cd")] * 6
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    taken, counted = [], collocations._counted_words

    def first_fails(texts, seed, minimum):
        taken.append(seed)
        return counted(texts, seed, minimum).withColumn("other", F.col("other") | F.lit(seed == 0))

    monkeypatch.setattr(collocations, "_counted_words", first_fails)
    assert sorted(rows_of(collocations.collocations(docs, 5))) == brute_phrases(rows, 5, 2000, 100)
    assert taken == [0, 1]


def test_phrase_scores_are_exact(spark):
    a, n, part = 10**12 + 1, 3 * 10**14 + 7, 10**13 + 9
    counts = spark.createDataFrame([([1], part, n), ([2], part, n), ([1, 2], a, n)], "words array<bigint>, n bigint, all bigint")
    assert [r.score for r in collocations._scored(counts, F.col("all")).collect()] == [1000 * a * n // part**2]


def test_phrases_at_the_edges(spark):
    schema = "lang string, text string"
    for rows in ([], [("en", None)], [(None, " ,,\n")], [("en", "one")] * 9):
        assert collocations.collocations(spark.createDataFrame(rows, schema), 2).collect() == []
    rows = [(None, "a b")] * 3 + [("und", "A  b")] * 3 + [("x", "w" * 50_000 + " v")] * 5
    assert sorted(rows_of(collocations.collocations(spark.createDataFrame(rows, schema), 5))) == brute_phrases(rows, 5, 2000, 100)
    ties = [("en", ". ".join(f"{x} {x}x" for x in "dbca") + ".")] * 5
    got = rows_of(collocations.collocations(spark.createDataFrame(ties, schema), 5, 3).orderBy("rank"))
    assert [r[2] for r in got] == ["a ax", "b bx", "c cx"]


# lines


def brute_lines(rows, min_chars, min_documents):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= min_chars and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(lower(line.strip(strip)), set())
            if len(held) < min_documents or doc_id == max(held):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def leaflets(rng, n):
    shared = ["All rights reserved © 2020 by us.", "click HERE to read more and more", "short", "éééééééééé exactly twenty", "x" * 19, "y" * 20]
    out = []
    for k in range(n):
        lines = [rng.choice([rng.choice(shared), f"a line of its own, number {rng.randrange(10 * n)}", "", rng.choice(shared).upper() + " \t", "\x0b " + rng.choice(shared)]) for _ in range(rng.randint(0, 8))]
        out.append((rng.choice([k, k, k, rng.randrange(n), None]), "\n".join(lines) if rng.random() < 0.95 else None))
    return out


@pytest.mark.parametrize("bits,bucket,small,documents", [(30, 2048, 200_000, 3), (20, 4, 0, 3), (16, 2048, 200_000, 2)])
def test_lines_are_those_of_brute_force(spark, monkeypatch, bits, bucket, small, documents):
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 16)
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    whole = line_dedup.broadcast_if_small
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: whole(df, small))
    rows = leaflets(random.Random(bits), 200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in line_dedup.deduplicated(docs, 20, documents).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    key = lambda r: tuple(map(str, r))
    want = brute_lines(rows, 20, documents)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[2] for r in want) > 50


def test_a_full_filter_suspects_all_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BITS", 16)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 16)
    rows = [(k, "\n".join(f"line {j} of a long list, all different {k // 3}" for j in range(2000))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.n_dropped for r in line_dedup.deduplicated(docs).collect()}
    assert out == {k: 0 if k % 3 == 2 else 2000 for k in range(60)}


def test_the_filter_leaves_single_keys_out(spark):
    rows = [(k, f"a line that nobody else has {k}\na line that all of them have\n" * 2) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.xxhash64("text"))
    seen = line_dedup.twice_seen(docs, 20, 20)
    assert line_dedup._suspects(docs, seen, 20, 20).count() < 510  # 500 of the common key


def test_lines_at_the_edges(spark):
    far = "this line stands in three documents"
    rows = [(1, far, "a", 7), (2, f"{far}\n", "b", None), (2, f"{far}\n", "b", None), (3, f"x\n{far} \n{far.upper()}", None, 1), (None, f"{far}\nown", "c", 2), (5, None, "d", 3), (6, "", "e", 4), (7, "\n\n" + "z" * 200_000, "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, LOST_ string, n_lines int")
    out = line_dedup.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "LOST_", "n_lines", "n_lines_", "n_dropped_"]
    got = sorted(((r.doc_id or 0, r.text, r.LOST_, r.n_lines, r.n_lines_, r.n_dropped_) for r in out.collect()), key=str)
    assert got == sorted(
        [
            (1, "", "a", 7, 1, 1), (2, "", "b", None, 2, 1), (2, "", "b", None, 2, 1), (3, f"x\n{far} \n{far.upper()}", None, 1, 3, 0), (0, "own", "c", 2, 2, 1),
            (5, "", "d", 3, 1, 0), (6, "", "e", 4, 1, 0), (7, "\n\n" + "z" * 200_000, "f", 5, 3, 0),
        ],
        key=str,
    )
    assert line_dedup.deduplicated(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        line_dedup.deduplicated(docs, min_documents=1)


@pytest.mark.parametrize("name", sorted(sql_twins.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql_twins.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect()) and want
