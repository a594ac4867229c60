"""Toxicity, secret scans and line dedup."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import linededup, secretscan, toxicity
from codesift.llm.common import word_hashes
from codesift.llm.toxicity import Words, drop_toxic, score_documents, word_grams

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "re", "ti", "on", "el", "so", "mu"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    bad = ["zgrak", "zgrakor", "zgrumel", "vilzok"]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = prose(rng, rng.randint(5, 120)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "an", "!"]))
        docs.append((i, " ".join(words), "en", "s", 1, "clash"))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None, None, None, None, None), (5001, "", "", "", 0, ""), (5002, "12 345 !!", "", "", 0, ""), (None, "zgrak zgrakor zgrumel", "", "", 0, ""), (5003, prose(rng, 30000) + " zgrakor", "", "", 0, ""), (0, docs[0][1], "en", "s", 1, "again")]
    labels += [(0, 0, 0), (None, 1, 1), (7, 0, None), (9999, 1, 1), (3, 1, 7)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(judged):
    docs, labels = judged
    rows = score_documents(docs, labels).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r["__score"] for r in rows}
    assert all(0 <= s <= 1 for s in by_id.values())
    held = [(r.doc_id, r["__score"]) for r in rows if r.held and r.doc_id is not None and r.doc_id < 1200]
    wrong = [i for i, s in held if (s >= toxicity.THRESHOLD) != (i % 8 == 0)]
    assert len(held) > 200 and len(wrong) <= 0.03 * len(held)
    assert by_id[5000] == by_id[5001] < toxicity.THRESHOLD  # null as empty
    assert by_id[None] >= toxicity.THRESHOLD


def test_held_out_fold(spark):
    import zlib

    df = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())


def test_labels_of_the_held_out_fold_teach_nothing(judged):
    docs, labels = judged
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r["__score"] for r in score_documents(docs, labels).collect()}
    b = {r.doc_id: r["__score"] for r in score_documents(docs, turned).collect()}
    assert a == b


def test_drop_toxic_and_missing_classes(judged, spark):
    docs, labels = judged
    kept = drop_toxic(docs, labels, 0.5)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {5000, 5001, 5002} <= ids and len([i for i in ids if i is not None and i < 1200 and i % 8 == 0]) <= 5
    one_class = score_documents(docs.limit(5), labels.where("toxic = 0")).collect()
    assert {r["__score"] for r in one_class} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert score_documents(empty, labels).count() == 0
    assert score_documents(docs.limit(3), labels.limit(0)).count() == 3


def test_counts_against_plain_python(judged):
    """The folded tables hold each class's gram counts, and the evidence is their discounted ratio."""
    docs, labels = judged
    rows = docs.join(labels.where("toxic in (0, 1)").dropDuplicates(["doc_id"]), "doc_id").where("doc_id between 1 and 60").select("text", "toxic")
    tables = toxicity.count_tables(rows.select("text", F.col("toxic").cast("long")))
    plain = {}
    for r in rows.collect():
        for w in r.text.lower().replace("!", " ").split():
            raw = b"\x02" * 5 + w.encode() + b"\x01"
            for i in range(5, len(raw)):
                key = (int.from_bytes(raw[i - 5 : i + 1], "big"), 1 - r.toxic)
                plain[key] = plain.get(key, 0) + 1
    assert tables[toxicity.TOP].sum() == sum(plain.values())
    for (gram, c), n in list(plain.items())[:200]:
        assert tables[toxicity.TOP, c, toxicity.cell(np.array([gram]), toxicity.TOP)[0]] >= n


def test_workers_get_little_and_need_little():
    """What is handed to every worker holds no empty columns, and scoring a full slice takes a bounded room beside it."""
    rng = np.random.default_rng(1)
    tables = rng.integers(0, 50, (10, 2, toxicity.BUCKETS)).astype(np.float32)
    handed = toxicity.handed_out(tables)
    assert sum(a.nbytes for a in handed.values()) < 52e6 < tables.nbytes
    words = Words(["".join(rng.choice(list("abcdefgh     "), 900_000))])
    tracemalloc.start()
    value = toxicity.evidence(handed, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(value, toxicity.evidence(tables, words)) and np.abs(value).max() > 0
    assert peak < 40e6


def test_word_grams_are_padded():
    words = Words(["Ab ab, cde"])
    grams, which = word_grams(words.data, words.first, words.last)
    assert sorted(np.bincount(which)) == [3, 4]
    assert int.from_bytes(b"\x02\x02\x02\x02\x02a", "big") in grams and int.from_bytes(b"\x02\x02\x02ab\x01", "big") in grams


def test_word_hashes():
    h, at = word_hashes(["Ab cd  ab", None, "", " x\ny ", "ab", "é É"])
    assert list(at) == [0, 3, 3, 3, 5, 6, 8]
    assert h[0] == h[2] == h[5] and len({*h.tolist()}) == 6  # A-Z only are lower-cased


SITES = "doc_id long, text string, source string, line string, n_lines string"


def plain_lines(rows, least):
    sites, first = {}, {}
    for k, text, site, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip():
                if site is not None:
                    sites.setdefault(line, set()).add(site)
                at = (k is None, k or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for k, text, *_ in rows:
        keep = text if text is None else "\n".join(
            x for pos, x in enumerate(text.split("\n")) if len(sites.get(x, ())) < least or first[x] == (k is None, k or 0, pos)
        )
        out.append((k, keep))
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lines = [f"own {i}", *rng.sample([f"shared {j}" for j in range(30)], 3), "", "  ", "everywhere"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 25}", "clash", "clash"))
    rows += [(400, None, "s1", None, None), (401, "", "s2", None, None), (402, "everywhere\n" * 50000, None, None, None), (None, "everywhere\nnull key", "s3", None, None)]
    df = spark.createDataFrame(rows, SITES)
    for least in (2, 10, 24):
        got = linededup.dedup_lines(df, min_sites=least)
        assert got.columns == [*df.columns, "__lines"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(plain_lines(rows, least), key=str)
    assert linededup.dedup_lines(spark.createDataFrame([], SITES)).count() == 0


def test_lines_near_the_threshold_are_counted_exactly(spark):
    lines = spark.range(0, 2000).select(F.lit(1).cast("long").alias("line"), F.col("id").cast("string").alias("site"), F.col("id").alias("at"))
    for least, there in ((1990, 1), (2000, 1), (2001, 0), (2010, 0)):
        assert linededup.spread_lines(lines, least).count() == there


def test_repeated_rows_keep_the_same_lines(spark):
    rows = [(1, "a\nb", f"s{i % 12}", "", "") for i in range(24)] + [(2, "a\nc", "z", "", "")]
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, SITES)).collect()]
    assert set(got) == set(plain_lines(rows, 10))


SECRET = "doc_id long, text string, source string, score string, value string"


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    hexa, rows = "0123456789abcdef", []
    for i in range(400):
        words = prose(rng, 40).split()
        key = "".join(rng.choices(hexa, k=40))
        extra = [
            f'token = "{key}"',
            f"password={key[:20]}",
            f"{prose(rng, 1)}.{i}@mail{i % 5}.example.com",
            "".join(rng.choices("0123456789", k=16)),
            "".join(rng.choices(["an", "re", "ti", "on", "el"], k=9)),
        ][i % 5]
        words.insert(20, extra)
        rows.append((i, " ".join(words), "src/app.py" if i % 2 else None, "clash", "clash"))
    rows += [(900, None, "", "", ""), (901, "", "", "", ""), (902, "a" * 40000, "x", "", ""), (903, "k=" + "f3" * 12 + "," + "AKIA" + "Q7" * 8, "x", "", "")]
    return spark.createDataFrame(rows, SECRET)


def test_secret_scan(leaks, spark):
    rows = secretscan.scan(leaks).collect()
    kind = {i: i % 5 for i in range(400)}
    hit = {r.id for r in rows if r.is_secret}
    assert {i for i, k in kind.items() if k in (0, 1)} <= hit
    assert not {i for i, k in kind.items() if k > 1} & hit
    assert len([r for r in rows if r.id == 903]) == 2 and {r.value for r in rows if r.id == 902} == {"a" * 40000}
    assert all(0 <= r.score <= 1 for r in rows)
    again = secretscan.scan(leaks).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_secret_scan_with_given_labels_and_nothing_to_learn(leaks, spark):
    found = secretscan.weak_labels(secretscan.with_features(secretscan.candidates(leaks), ["rean"]))
    given = found.where("id < 200").select("value", "word", "before", "after", "path", "label")
    hit = {r.id for r in secretscan.scan(leaks, labelled=given).collect() if r.is_secret}
    held = [i for i in range(200, 400) if i % 5 < 2]
    assert len(hit & set(held)) >= 0.95 * len(held)
    few = secretscan.scan(leaks.where("doc_id % 5 = 3 and doc_id < 400")).collect()
    assert {r.score for r in few} <= {0.0, 1.0}
    assert secretscan.scan(spark.createDataFrame([], SECRET)).count() == 0


def test_short_and_url_secrets_are_candidates(leaks, spark):
    odd = {
        1001: ("password='hunter2!x'", "hunter2!x"), 1002: ('pwd = "k9$z"', "k9$z"), 1003: ("api_key: 'ab:12#cd%34'", "ab:12#cd%34"),
        1004: ('"client_secret" => "s3!t"', "s3!t"), 1005: ("PASSWORD=tiny7", "tiny7"), 1006: ('secret ="x1y2"', "x1y2"),
        1007: ("see postgres://admin:pa55w0rdx@db.host.net/main now", "pa55w0rdx"), 1008: ("ftp://u:q!9@h.org", "q!9"),
    }
    rows = [(i, f"the {t} end", None, "", "") for i, (t, _) in odd.items()] + [(1100, "the password is here and author: anna", None, "", "")]
    found = secretscan.candidates(spark.createDataFrame(rows, SECRET))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append(r.value)
    assert all(v in got[i] for i, (_, v) in odd.items()) and 1100 not in got
    mail = [(i, f"the mail a{i}.bcdefghij@mail.host.net", None, "", "") for i in range(2)] + rows
    labels = secretscan.weak_labels(secretscan.with_features(secretscan.candidates(spark.createDataFrame(mail, SECRET)), [])).collect()
    assert {(r.id, r.label) for r in labels if r.id in (0, 1, 1007)} == {(0, 0), (1, 0), (1007, 1)}
    hit = {(r.id, r.value) for r in secretscan.scan(leaks.union(spark.createDataFrame(rows * 10, SECRET))).collect() if r.is_secret}
    assert {(i, v) for i, (_, v) in odd.items()} <= hit


def test_coverage_is_by_all_words(spark):
    docs = spark.createDataFrame([("lorema ipsumo dolora rare",)] * 3 + [("once",)], "text string")
    assert {r.w for r in secretscan.dictionary(docs).collect()} == {"lorema", "ipsumo", "dolora", "rare"}
    found = spark.createDataFrame([("xxLoremaIPSUMO9rarely", "", "", "", ""), ("9f8e7d", "", "", "", "")], "value string, word string, before string, after string, path string")
    got = {r.value: r.coverage for r in secretscan.with_features(found, secretscan.dictionary(docs)).collect()}
    assert got == {"xxLoremaIPSUMO9rarely": 16 / 21, "9f8e7d": 0.0}
