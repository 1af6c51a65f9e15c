"""The training-data operators as Spark jobs: edge cases, brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat_windows, components, decontaminate, jaccard_join, language_id, packing, pseudonyms, quality_classifier, queries, secrets_scan, weak_supervision
from helixframe.llm.common import checkpointed
from helixframe.llm.tokenizers import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t", "en", "s", 3),
    (4, "one two three", "en", "s", 13),
    (4, "one two three", "en", "s", 13),
    (5, "One TWO three", "fr", None, 13),
    (None, "one two three", "fr", "s", 13),
    (6, "w" * 30_000 + " " + "long text " * 3000, "de", "s", 60_000),
    (7, "é ñ ü 12 4111111111111111", "es", "s", 25),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# pseudonyms


def luhn(digits):
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def test_feistel_is_a_permutation(spark):
    rows = spark.range(1000).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = {r.p for r in rows.select(pseudonyms.permuted_digits("k", "x", F.col("d")).alias("p")).collect()}
    assert len(out) == 1000 and all(re.fullmatch(r"\d{3}", p) for p in out)
    days = spark.range(36525).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = {r.p for r in days.select(pseudonyms._date("k", F.col("d")).alias("p")).collect()}
    assert len(moved) == 36525 and all("2000-01-01" <= d <= "2099-12-31" for d in moved)
    numbers = spark.range(3000).select(F.format_string("%03d-%02d-%04d", (F.col("id") % 897 + 1), F.col("id") % 99 + 1, F.col("id") % 9999 + 1).alias("s"))
    ssn = numbers.select("s", pseudonyms._ssn("k", F.col("s")).alias("p")).distinct().collect()
    assert len({r.p for r in ssn if r.p}) == len([r for r in ssn if r.p]) > 2500
    assert all(r.p is None for r in ssn if r.s.startswith("666"))


def test_pseudonyms_link_and_keep_format(spark):
    text = "card 4111 1111 1111 1111, 4111111111111112 not; +1 (017) 555-7713; 97.51.17.173. 300.1.1.1; 2021-02-28 2021-02-30 05.06.1999; GB82 WEST 1234 5698 7654 32; 123-45-6789; und.34@mail7.example.com"
    df = spark.createDataFrame([(1, text), (2, "again 12 4111111111111111 97.51.17.173 +1 (017) 555-7713 97.51.17.173 UND.34@MAIL7.example.com!"), (3, "plain 12 words 3.5 v1.2.3")], "doc_id int, text string")
    one, two, three = (r for r in pseudonyms.pseudonymised(df, "key").orderBy("doc_id").collect())
    for secret in ("4111 1111", "555-7713", "97.51.17.173", "2021-02-28", "05.06.1999", "WEST 1234", "123-45-6789", "und.34"):
        assert secret not in one.text
    for left in ("4111111111111112", "300.1.1.1", "2021-02-30"):
        assert left in one.text
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", one.text).group(1)
    assert luhn(card.replace(" ", "")) and card.replace(" ", "") in two.text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one.text)
    ip = re.search(r"; (\d+\.\d+\.\d+\.\d+)\.", one.text).group(1)
    assert ip in two.text and all(int(x) < 256 for x in ip.split("."))
    iban = re.search(r"GB\d\d WEST(?: \d{4}){3} \d\d", one.text).group().replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    mail = re.search(r"user-\w+@", one.text).group()
    assert mail in two.text
    assert three.text == "plain 12 words 3.5 v1.2.3" and three.pii_kinds == []
    other = pseudonyms.pseudonymised(df, "another key").orderBy("doc_id").first()
    assert other.text != one.text


def test_pseudonyms_take_every_valid_shape(spark):
    """Letters in any group of an account number, telephone groups of any length, cards of 14 and 19 digits; and neighbours stay apart."""
    whole = [
        "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB29NWBK60161331926819", "+44 7911 123456", "+49 30 1234567", "+41 44 668 18 00",
        "+44 (0)20 7946 0958", "+1 555-123-4567", "3056 930902 5904", "4000 0000 0000 0000 006", "4111-1111-1111-1111", "6200000 000000000000",
    ]
    pairs = [
        ("FR14 2004 1010 0505 0001 3M02 606", "4111 1111 1111 1111"), ("+41 44 668 18 00", "4111 1111 1111 1111"), ("+49 30 1234567", "4111 1111 1111 1111"),
        ("4111 1111 1111 1111", "4012 8888 8888 1881"), ("+49 30 1234567", "2021-02-28"), ("4111 1111 1111 1111", "13.05.1999"), ("4111 1111 1111 1111", "123-45-6789"), ("+41 44 668 18 00", "+41 44 668 18 01"),
    ]
    texts = whole + [f"{a} {b}" for a, b in pairs] + ["4111 1111 1111 1111 123", "order 12345 4111 1111 1111 1111", "XX12 4111 1111 1111 1111", "+41-44-668-18-00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {texts[r.doc_id]: r for r in pseudonyms.pseudonymised(df, "key").collect()}
    for text in whole:
        assert len(got[text].pii_kinds) == 1 and got[text].text != text and [c.isdigit() for c in got[text].text] == [c.isdigit() for c in text], text
    alone = {x for pair in pairs for x in pair}
    single = {r.text: r.made for r in pseudonyms.pseudonymised(spark.createDataFrame([(x, x) for x in alone], "text string, made string"), "key").select(F.col("made").alias("text"), F.col("text").alias("made")).collect()}
    for a, b in pairs:
        assert got[f"{a} {b}"].text == f"{single[a]} {single[b]}", (a, b)
    card = single["4111 1111 1111 1111"]
    assert got["4111 1111 1111 1111 123"].text == f"{card} 123"
    assert got["order 12345 4111 1111 1111 1111"].text == f"order 12345 {card}"
    assert got["XX12 4111 1111 1111 1111"].text == f"XX12 {card}"
    assert got["+41-44-668-18-00"].text.replace("-", " ") == single["+41 44 668 18 00"]


def draw(key, tweak, turn, value):
    return int(hashlib.sha256(f"{key}|{tweak}|{turn}|{value}".encode()).hexdigest()[:15], 16)


def feistel_by_hand(key, tweak, left, right, left_size, right_size):
    for turn in range(pseudonyms.ROUNDS):
        if turn % 2 == 0:
            left = (left + draw(key, tweak, turn, right)) % left_size
        else:
            right = (right + draw(key, tweak, turn, left)) % right_size
    return left, right


def date_by_hand(key, text):
    import datetime

    slash = text.split("/")
    turned = len(slash) == 3 and int(slash[0]) > 12
    if len(slash) == 3:
        month, day = (int(slash[1]), int(slash[0])) if turned else (int(slash[0]), int(slash[1]))
        when = datetime.date(int(slash[2]), month, day)
    elif "." in text:
        d, m, y = map(int, text.split("."))
        when = datetime.date(y, m, d)
    else:
        when = datetime.date.fromisoformat(text)
    base = when.year // 100 * 100
    first = datetime.date(base, 1, 1)
    sizes = (75, 487) if base % 400 == 0 else (92, 397)
    at = (when - first).days
    while True:
        left, right = feistel_by_hand(key, f"date:{base}", at // sizes[1], at % sizes[1], *sizes)
        at = left * sizes[1] + right
        new = first + datetime.timedelta(at)
        if (when.day > 12) == (new.day > 12):
            break
    wide = len(text) == 10
    show = lambda *parts: [f"{p:02d}" if wide else str(p) for p in parts]
    if "-" in text:
        return new.isoformat()
    if "." in text:
        return ".".join([*show(new.day, new.month), f"{new.year}"])
    return "/".join([*(show(new.day, new.month) if turned else show(new.month, new.day)), f"{new.year}"])


def test_dates_of_forty_years_stay_apart(spark):
    """All days of 1980 to 2019 in four spellings: as by hand, and no two strings of different dates get one pseudonym."""
    days = spark.range(14_610).select(F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.explode(F.array(*[F.date_format("d", s) for s in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")])).alias("text")).distinct()
    got = {r.was: r.text for r in pseudonyms.pseudonymised(texts.select("text", F.col("text").alias("was")), "k").collect()}
    assert len(got) > 52_000 and len(set(got.values())) == len(got)
    for was in random.Random(1).sample(sorted(got), 1500):
        assert got[was] == date_by_hand("k", was), was


def test_all_notations_of_a_day_stay_linked(spark):
    """All days of 1980 to 2019: one pseudonym a day in five notations, and no two days with one."""
    import datetime

    notations = {"yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "d.M.yyyy": "%d.%m.%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y"}
    days = spark.range(14_610).select(F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select("d", F.concat_ws(" ", *[F.date_format("d", s) for s in notations]).alias("text"))
    days_of = {}
    for r in pseudonyms.pseudonymised(texts, "k").collect():
        parts = r.text.split(" ")
        read = [datetime.datetime.strptime(p, s).date() for k, (p, s) in enumerate(zip(parts, notations.values(), strict=True)) if k < 4 or r.d.day > 12]
        assert len(set(read)) == 1 and len(r.pii_kinds) == 5
        days_of[r.d] = read[0]
    assert len(set(days_of.values())) == len(days_of) == 14_610


def test_phone_spellings_stay_linked(spark):
    groups = [
        ["+4915112345678", "+49 151 1234 5678", "+49-151-12345678", "+49 (0)151 1234 5678", "+49 (0) 151 12345678".replace(") ", ")"), "0049 151 12345678", "00 49 151 1234 5678"],
        ["+15551234567", "+1 555-123-4567", "+1 (555) 123-4567", "+1.555.123.4567", "001 555 123 4567"],
        ["+420601123456", "+420 601 123 456"], ["+35312345678", "+353 1 234 5678"],
    ]
    df = spark.createDataFrame([(g, t) for g, ts in enumerate(groups) for t in ts], "g int, text string")
    got = defaultdict(set)
    for r in pseudonyms.pseudonymised(df.withColumn("was", F.col("text")), "key").collect():
        assert r.pii_kinds == ["phone"] and [c if not c.isdigit() else "0" for c in r.text] == [c if not c.isdigit() else "0" for c in r.was]
        got[r.g].add(re.sub("^00", "+", re.sub("[^0-9+]", "", r.text.replace("(0)", ""))))
    assert [len(got[g]) for g in range(4)] == [1, 1, 1, 1]
    for g, code in enumerate(("+49", "+1", "+420", "+353")):
        assert min(got[g]).startswith(code) and min(got[g]) != re.sub("[^0-9+]", "", groups[g][0])
    filled = spark.createDataFrame([("0012345678 00000012345678",)], "text string")
    assert pseudonyms.pseudonymised(filled, "key").first().pii_kinds == []


def test_pseudonyms_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("call +1 555-123-4567", 1, "x", 2)], "text string, pii_found_ int, PII_MADE_ string, pii_kinds int")
    r = pseudonyms.pseudonymised(df, "k").first()
    assert (r.pii_found_, r.PII_MADE_, r.pii_kinds) == (1, "x", ["phone"])


def test_pseudonyms_edges(odd, none):
    rows = pseudonyms.pseudonymised(odd.withColumn("pii_kinds", F.lit(1)), "k").collect()
    assert len(rows) == len(ODD)
    for r, o in zip(rows, ODD, strict=True):
        assert (r.text == o[1]) == (o[0] != 7)
    assert pseudonyms.pseudonymised(none, "k").count() == 0


# weak supervision


def brute_counts(text):
    w = re.findall(WORD, text or "")
    seen, covered = defaultdict(list), set()
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p for k in places for p in range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_weak_supervision(spark, odd, none):
    rng = random.Random(1)
    extra = [(100 + k, "\n".join(" ".join(rng.choice("ab|c#") for _ in range(rng.randint(0, 30))) for _ in range(4)), None, None, 0) for k in range(40)]
    docs = odd.union(spark.createDataFrame(extra, SCHEMA)).union(documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = weak_supervision.judged(docs).collect()
    assert len(rows) == docs.count()
    want = Counter((i, *brute_counts(t)) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in weak_supervision.judged(documents(spark)).collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.95
    assert weak_supervision.judged(none).count() == 0


def planted_votes(rng, prior, many, good=(0.95, 0.9, 0.97, 0.85, 0.92), bad=(0.4, 0.3, 0.5, 0.2, 0.6)):
    counts = Counter()
    for _ in range(many):
        side = good if rng.random() < prior else bad
        counts[tuple(None if rng.random() < 0.1 else int(rng.random() < p) for p in side)] += 1
    return counts


def em_by_hand(counts, prior, good, bad, rounds):
    """(log likelihood, prior, good, bad) of one start, in plain Python."""
    total = None
    for _ in range(rounds):
        weight, total = {}, 0.0
        for v, n in counts.items():
            g, b = prior, 1 - prior
            for x, p, q in zip(v, good, bad, strict=True):
                if x is not None:
                    g, b = g * (p if x else 1 - p), b * (q if x else 1 - q)
            weight[v], total = g / (g + b), total + n * np.log(g + b)
        some = sum(counts.values())
        up = lambda side, k: (sum(n * side(v) for v, n in counts.items() if v[k] == 1) + 0.5) / (sum(n * side(v) for v, n in counts.items() if v[k] is not None) + 1)  # noqa: E731, B023
        good, bad = [up(lambda v: weight[v], k) for k in range(len(good))], [up(lambda v: 1 - weight[v], k) for k in range(len(good))]  # noqa: B023
        prior = (sum(n * weight[v] for v, n in counts.items()) + 0.5) / (some + 1)
    return total, prior, good, bad


def test_em_against_a_plain_loop(spark):
    names = list("abcde")
    counts = planted_votes(random.Random(2), 0.7, 400)
    df = checkpointed(spark.createDataFrame([(*v, float(n)) for v, n in counts.items()], "a int, b int, c int, d int, e int, n double"))
    model = weak_supervision.fitted(df, names, rounds=6, tolerance=0.0)
    total, prior, good, bad = max(em_by_hand(counts, p, [g] * 5, [b] * 5, 6) for p, g, b in weak_supervision.STARTS)
    assert model["log_likelihood"] == pytest.approx(total) and model["prior"] == pytest.approx(prior)
    for k, c in enumerate(names):
        assert model["rules"][c] == pytest.approx((good[k], bad[k]))
    assert weak_supervision.fitted(df.limit(0), names)["prior"] == weak_supervision.STARTS[0][0]


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_em_recovers_planted_shares(spark, prior):
    counts = planted_votes(random.Random(3), prior, 30_000)
    df = checkpointed(spark.createDataFrame([(*v, float(n)) for v, n in counts.items()], "a int, b int, c int, d int, e int, n double"))
    model = weak_supervision.fitted(df, list("abcde"), tolerance=1e-6)
    assert abs(model["prior"] - prior) < 0.05
    for c, p, q in zip("abcde", (0.95, 0.9, 0.97, 0.85, 0.92), (0.4, 0.3, 0.5, 0.2, 0.6), strict=True):
        assert abs(model["rules"][c][0] - p) < 0.06 and abs(model["rules"][c][1] - q) < 0.06


def test_function_words_abstain_elsewhere(spark):
    df = spark.createDataFrame([(1, "слово другое " * 40), (2, "the of and " * 20), (3, "the " + "zq " * 80)], "doc_id bigint, text string")
    rows = weak_supervision.measured(df).select("doc_id", weak_supervision.rules()["function_words"].alias("v")).collect()
    assert {r.doc_id: r.v for r in rows} == {1: None, 2: 1, 3: 0}


# secrets, languages, decontamination


def test_secret_scan_edges(odd, none):
    file = tokenizer_path("byte_bpe_50k.tiktoken")
    assert secrets_scan.scanned(odd, file).count() == len(ODD)
    assert secrets_scan.scanned(none, file).count() == 0


def test_secret_scan_keeps_columns_and_drops_known_forms(spark):
    hexes = {n: "".join(random.Random(n).choices("0123456789abcdef", k=n)) for n in (31, 32, 40, 64, 70)}
    known = [hexes[31].upper().replace("A", "B"), "123e4567-e89b-12d3-a456-426614174000", "1234567890123456", "2024-01-02-03-04-05-06", hexes[40].upper(), hexes[64].upper()]
    df = spark.createDataFrame([(x, f"id {x}.", "mine", 3) for x in [*known, *hexes.values()]], "x string, text string, Secret_Spans string, kind int")
    got = {r.x: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secrets_scan.scanned(df, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    assert all(got[x] == [] for x in known[1:]), got
    assert all(got[hexes[n]] == [("hex", 3, 3 + n)] for n in (32, 40, 64, 70))
    assert [s[0] for s in got[hexes[31]]] == ["token"]


def test_secret_scan_precision_and_recall(spark):
    """Random keys of five alphabets planted in the given texts: nearly all are found, and few runs of the texts are taken for keys."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = [letters, letters.upper(), letters + letters.upper(), letters + "0123456789", letters + letters.upper() + "0123456789+/"]
    keys = ["".join(rng.choices(a, k=rng.randint(16, 48))) for a in alphabets for _ in range(200)]
    texts = [r.text for r in documents(spark).where("length(text) > 100").select("text").limit(100).collect()]
    df = spark.createDataFrame([(k, texts[k % len(texts)][:500], key) for k, key in enumerate(keys)], "k int, head string, key string")
    found = secrets_scan.scanned(df.select("k", "key", F.length("head").alias("n"), F.concat_ws(" ", "head", "key", F.lit("."), F.lit("end")).alias("text")), tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    hit = [any(s.start <= r.n + 1 and s.end >= r.n + 1 + len(r.key) for s in r.secret_spans) for r in found]
    assert np.mean(hit) > 0.97
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = secrets_scan.scanned(docs, tokenizer_path("byte_bpe_50k.tiktoken")).select(F.explode("secret_spans").alias("s")).where("s.kind = 'token'").count()
    runs = sum(len(secrets_scan.RUN.findall(r.text or "")) for r in docs.collect())
    assert extra < 40 and runs > 100


def test_secret_scan_tells_letter_keys_from_words(spark):
    """Random letters are found with and without digits or separators, from 16 characters; words, names and paths are not."""
    keys = ["xKqWzRtYpLmNbVcXzAsDqPwE", "qzxvkjwpfhgtbmxqzvkw", "xKqWzRtYpLmNbVcXzAsD42", "xKqWzRtYpL/mNbVcXzAsDqPwE", "xKq9WzR7tYpL2mNb"]
    plain = [
        "internationalization", "INTERNATIONALIZATION", "getElementsByTagNameAndClass", "src/main/python/operators", "long_variable_name_with_words", "/usr/local/share/applications/",
        "Commission2000-Report-2004", "123e4567-e89b-12d3-a456-426614174000", "0000-1111-2222-3333", "====================",
    ]
    df = spark.createDataFrame([(x, f"see {x} here") for x in keys + plain], "x string, text string")
    got = {r.x: r.secret_spans for r in secrets_scan.scanned(df, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    for x in keys:
        assert [(s.kind, s.start, s.end) for s in got[x]] == [("token", 4, 4 + len(x))], x
    for x in plain:
        assert got[x] == [], x


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    parser = language_id.learned(docs, ~held)
    rows = language_id.identified(docs.where(held), parser).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    got = language_id.identified(odd, parser).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and len(got) == len(ODD)
    empty = language_id.learned(none, F.lit(True))
    assert {(r.lang_pred, r.lang_score) for r in language_id.identified(odd, empty).collect()} == {("und", 0.0)}


def test_language_id_by_blocks_and_unbroken(spark, monkeypatch):
    """Blocks tell every document of the table the language that the unbroken parse tells."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    parser = language_id.learned(docs, F.lit(True))
    texts = sorted((language_id.folded(r.text or "") for r in docs.collect()), key=len)
    blocks = [x[0] for x in parser.judged(texts)]
    monkeypatch.setattr(language_id, "BLOCK", 4096)
    longer = [x[0] for x in parser.judged(texts)]
    short = [k for k, t in enumerate(texts) if len(t) <= 4096]
    assert len(short) > 0.8 * len(texts) and [blocks[k] for k in short] == [longer[k] for k in short]
    monkeypatch.setattr(language_id, "BLOCK", 1 << 17)
    assert len(texts[-1]) <= 1 << 17
    rest = range(len(short), len(texts))
    assert [blocks[k] for k in rest] == [x[0] for x in parser.judged([texts[k] for k in rest])]


def test_language_id_in_many_scripts(spark):
    """Alphabets of thousands of letters, several scripts side by side, and columns of any name."""
    rng = random.Random(3)
    letters = {"zh": [chr(0x4E00 + k) for k in range(3000)], "ja": [chr(0x3041 + k) for k in range(80)] + [chr(0x4E00 + k) for k in range(0, 3000, 7)], "ru": [chr(0x430 + k) for k in range(32)], "el": [chr(0x3B1 + k) for k in range(24)], "ar": [chr(0x627 + k) for k in range(30)], "en": list("abcdefghijklmnopqrstuvwxyz")}
    words = {k: ["".join(rng.choices(v, k=rng.randint(1, 4))) for _ in range(400)] for k, v in letters.items()}
    say = lambda k: " ".join(rng.choices(words[k], k=60))
    train = spark.createDataFrame([(k, say(k)) for k in letters for _ in range(60)], "lang string, text string")
    parser = language_id.learned(train, F.lit(True))
    new = spark.createDataFrame([(k, say(k), "mine", 7) for k in letters for _ in range(10)], "lang string, text string, Lang_Pred string, lang_score int")
    got = language_id.identified(new, parser).collect()
    assert len(got) == 60 and np.mean([r.lang == r.lang_pred for r in got]) == 1.0


def test_language_id_with_rare_labels_and_copies(spark):
    """A label with one short text, a language of short texts only, and many copies of one text leave the others' samples whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    copied = docs.where(~held & (F.length("text").between(200, 400))).groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    copies = copied.crossJoin(spark.range(400)).select(F.lit(-1).cast("bigint").alias("doc_id"), "lang", "text")
    rare = spark.createDataFrame([(-2, "xx", "zwq vrk ptl " * 17)] + [(-3, "yy", f"plouk{'abcde'[k % 5]} trizb groum{'aeiou'[k % 5]} vlaxk dwont{'xyz'[k % 3]}") for k in range(60)], "doc_id bigint, lang string, text string")
    training = docs.where(~held).unionByName(copies).unionByName(rare)
    parser = language_id.learned(training, F.lit(True))
    assert {"xx", "yy"} <= set(parser.languages)
    sizes = dict(zip(parser.languages, map(len, parser.texts), strict=True))
    assert all(n > 20_000 for k, n in sizes.items() if k not in ("xx", "yy")), sizes
    rows = language_id.identified(docs.where(held), parser).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    new = spark.createDataFrame([("trizb plouka vlaxk groume dwontx trizb vlaxk",)], "text string")
    assert language_id.identified(new, parser).first().lang_pred == "yy"


def test_language_id_with_many_labels(spark, monkeypatch):
    """Hundreds of labels share what the driver takes, each is rated against itself only, and a column of something else fails."""
    docs = spark.range(6000).select("id", (F.col("id") % 600).cast("string").alias("lang"), F.concat_ws(" ", F.lit("some text"), F.repeat(F.concat(F.sha2((F.col("id") % 600).cast("string"), 256), F.lit(" ")), 30), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(language_id, "ALL_CHARACTERS", 600 * 500)
    began, asked = time.time(), []
    true = language_id.CrossParser.phrases
    monkeypatch.setattr(language_id.CrossParser, "phrases", lambda self, blocks, which: asked.append(len(which)) or true(self, blocks, which))
    parser = language_id.learned(docs, F.lit(True))
    assert len(parser.languages) == 600 and sum(map(len, parser.texts)) <= 600 * 500 and max(asked) == 1 and time.time() - began < 60
    monkeypatch.undo()
    with pytest.raises(ValueError, match="languages"):
        language_id.learned(docs.withColumn("lang", F.col("id").cast("string")), F.lit(True))


def test_decontamination(spark, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    item = bench.first()
    planted = spark.createDataFrame([(900, "before " + item.text.upper() + " after", None, None, 0), (901, "x " * 5000 + item.text, None, None, 0)], SCHEMA)
    docs = odd.union(planted).withColumn("n_words", F.lit("clash"))
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[900].contaminated and str(item.item_id) in rows[900]["items"]
    assert rows[901].n_hit > 0 and not rows[901].contaminated
    assert not rows[1].contaminated and rows[1].n_words == 0 and rows[4].n_words == 3
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 1
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def test_decontamination_with_clashing_names(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x a b c", 7, "mine", "s", "w"), (2, "y", 8, "mine", "s", "w")], "doc_id bigint, text string, hit_items bigint, Hit_Spans string, hit_n_words string, n_words string")
    kept = decontaminate.decontaminated(docs, bench)
    assert [tuple(r) for r in kept.collect()] == [(2, "y", 8, "mine", "s", "w")] and kept.columns == docs.columns
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[1].hit_items == 7 and rows[1].n_words == 4 and rows[1]["items"] == ["1"] and rows[1].contaminated
    assert [r.hit_items for r in decontaminate.find_windows(docs, bench).orderBy("doc_id").collect()] == [[1], []]


def test_item_blocks_add_up(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"p{k} q{k} r{k}") for k in range(9)] + [(None, "x"), (10, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "p0 q0 r0 p8 q8 r8 z"), (2, "p0 q0")], "doc_id bigint, text string")
    whole = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    plain = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b: plain(b, 20))
    monkeypatch.setattr(decontaminate, "PASSES", 2)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == whole
    assert "n_hit=6" in whole[0]


# packing


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = odd.union(documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = packing.pack(packing.cut_pieces(docs, path), shard_pieces=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_row].append(r)
    assert len(by) == docs.count()
    want = Counter()
    for d in docs.collect():
        ids = np.array([*plain.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[d.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(packing.cut_pieces(none, path)).count() == 0


# Jaccard join


def brute_join(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, num):
    rng = random.Random(k)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A b"), (6, "a b"), (6, "a b")]
    for i in range(10, 90):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 999))
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice(base) for _ in range(40)) + " common passage of ten words that many documents do share") for i in range(30)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n int")
    got = Counter(map(tuple, jaccard_join.joined(df, k, num, 100).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_join(rows, k, num, 100)


def test_fragments_hold_equal_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    digests = checkpointed(jaccard_join._digests(docs, 3))
    sketch = jaccard_join._summed(digests.where("part is not null").select("part", "counts"))
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    ids = checkpointed(docs.select("doc_id"))
    sizes = {r.fragment: r.n for r in jaccard_join._sets(docs, ids, 3, held).groupBy("fragment").agg(F.sum(F.size("grams")).alias("n")).collect()}
    assert sorted(sizes) == list(range(jaccard_join.FRAGMENTS)) and max(sizes.values()) < 1.3 * min(sizes.values())


def test_jaccard_join_of_a_large_bucket(spark, monkeypatch):
    """5,000 texts that share their rarest words and are not linked, and pairs among them that are; buckets of 100."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 100)
    rng = random.Random(12)
    rows = []
    for i in range(5000):
        rows.append((i, "shared head of all these texts " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(24))))
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(0, 5000, 250)]
    got = {r.doc_id: r.component_id for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_jaccard_edges(spark, odd, none):
    got = jaccard_join.joined(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = jaccard_join.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 4, 6, 7]
    assert jaccard_join.joined(none).count() == 0 and jaccard_join.deduplicated(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# chat


def windows_by_hand(turns, budget, history, count):
    """Windows of one conversation in order: (turns of context, own turns), each turn a (role, text)."""
    made, own, context = [], [], []
    for k, turn in enumerate(turns):
        if own and sum(map(count, context + own)) + count(turn) > budget:
            made.append((context, own))
            own = []
        if not own:
            force = max((j for j in range(k) if turns[j][0] == "system"), default=None)
            context = [turns[j] for j in range(max(0, k - history), k) if j != force]
            if turn[0] == "system":
                force = None
            while True:
                full = ([turns[force]] if force is not None else []) + context
                if not full or sum(map(count, full)) + count(turn) <= budget:
                    break
                if context:
                    context = context[1:]
                else:
                    force = None
            context = full
        own.append(turn)
    return made + ([(context, own)] if own else [])


@pytest.mark.parametrize(("budget", "history", "long"), [(1024, 2, 4096), (40, 0, 4096), (60, 3, 4096), (200, 2, 100)])
def test_chat_round_trip(spark, budget, history, long):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    told = r"\### Assistant: </turn> ok"
    odd = [(-7, 0, "user", told), (-7, 1, "assistant", told), (-8, 0, r"a:\b", "####\\\\ </turn>\n### user: x </turn>\n"), (-8, 1, "assistant", None), (-8, 2, "assistant", "t" * 5000 + " </turn"), (-8, 3, None, "\\"), (None, 0, "assistant", "n"), (-9, None, "assistant", "q\n"), (-9, 4, "assistant", "same"), (-9, 4, "assistant", "same")]
    odd += [(-10, k, "system" if k in (0, 300) else ("assistant", "user")[k % 2], f"text {k} " * (2 + k % 7)) for k in range(3000)]
    odd += [(-11, k, "system" if k == 0 else "user", "word " * (2000 if k == 0 else 3)) for k in range(5)]
    columns = "conv_id bigint, turn bigint, role string, text string"
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, columns)).withColumn("window", F.lit("clash"))
    made = chat_windows.windows(df, budget, history, long_turns=long)
    got = {r.conv_id: r for r in chat_windows.digests(made).collect()}
    assert got == {r.conv_id: r for r in chat_windows.conversation_digests(df, budget, history, long_turns=long).collect()}
    cut = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: (r.part or 0, r.window)):
        cut[r.conv_id].append(r)
        assert r.n_tokens == len(plain.encode(r.text, add_special_tokens=False).ids)
        assert r.n_tokens <= budget or (r.n_context == 0 and r.text.count(" </turn>\n") == 1)
    turns = defaultdict(list)
    for r in df.collect():
        turns[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        if len(rows) <= long:  # windows as by hand
            count = lambda t: len(plain.encode(f"### {chat_windows._ROLE_CONTROL.sub(lambda m: chr(92) + m.group(), t[0])}: {chat_windows.escaped(t[1])} </turn>\n", add_special_tokens=False).ids)
            cache = {}
            counted = lambda t: cache.setdefault(t, count(t))  # noqa: E731, B023
            want = windows_by_hand([t[1:] for t in rows], budget, history, counted)
            assert [(w.n_context, w.text.count(" </turn>\n")) for w in cut[conv]] == [(len(c), len(c) + len(o)) for c, o in want], conv
    if long == 100:
        first = {w.part: w for w in cut[-10] if w.window == 0}
        assert len(first) == 3 and all(w.n_context == 1 + history and w.text.startswith("### system: text 300 ") for p, w in first.items() if p)
    assert chat_windows.digests(chat_windows.windows(df.limit(0))).count() == 0 and chat_windows.conversation_digests(df.limit(0)).count() == 0


# quality classifier


def test_quality_classifier(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_classifier.learned(docs.where(~held), labels.where(~held))
    rows = quality_classifier.scored(docs.where(held), model).join(labels, "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    got = quality_classifier.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality_score <= 1 for r in got)
    assert {r.quality_score for r in quality_classifier.scored(odd, quality_classifier.learned(odd, labels.limit(0))).collect()} == {0.5}
    assert quality_classifier.scored(none, None).count() == 0


def test_quality_classifier_with_repeated_ids_and_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one = quality_classifier.learned(docs, labels)
    many = quality_classifier.learned(docs.union(docs.orderBy(F.rand(3))).repartition(5), labels.union(labels))
    named = docs.limit(50).withColumns({"Quality_Score": F.lit("mine"), "x": F.lit(1)})
    first, again = (quality_classifier.scored(named, m).select("quality_score", "x").collect() for m in (one, many))
    assert [r.quality_score for r in first] == [r.quality_score for r in again] and all(r.x == 1 for r in first)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns
    before = [(r.doc_id, r.text) for r in kept.collect()]
    single = {i for (i, _, c), n in brute_join(before, 5, 80, 100).items() if i == c}
    deduped = corpus_pipeline.deduplication(spark, kept, SF)
    assert deduped.columns == columns and {r.doc_id for r in deduped.collect()} == single
    clean = corpus_pipeline.decontamination(spark, deduped, SF)
    bench = {tuple(w[j : j + min(13, len(w))]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [decontaminate.words(r.text.encode())] for j in range(max(1, len(w) - 12))}
    expected = set()
    for r in deduped.collect():
        w = decontaminate.words(r.text.encode())
        hit = {p for n in {len(b) for b in bench} for at in range(len(w) - n + 1) if tuple(w[at : at + n]) in bench for p in range(at, at + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            expected.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == expected and clean.columns == columns
    private = corpus_pipeline.personal_data(spark, clean, SF)
    assert private.columns == columns and private.count() == clean.count()
    assert all(r.n_chars == len(r.text) for r in private.collect())
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.collect()} == expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "pii", "best-fit packing"]


def test_queries_have_their_columns(spark):
    found = {f"op{k}": q for q in queries.queries() for k in [q.split("_")[0][2:]]}
    assert sorted(found, key=lambda x: int(x[2:])) == [f"op{k}" for k in range(1, 14)]
    n = documents(spark).count()
    for name in ("op1_feistel_pseudonyms", "op2_weak_supervision", "op3_secret_scan", "op4_language_id", "op6_benchmark_decontamination", "op7_ngram_jaccard_join", "op10_positive_unlabelled_quality", "op11_periodic_runs", "op13_line_dedup"):
        assert queries.queries()[name](spark, SF).count() == n
