"""Fill-in-middle, centroid clustering and decontamination against plain versions, with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import centroids, fim, winnow
from codesift.llm.common import free_name

NAN, INF = float("nan"), float("inf")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# ------------------------------------------------------------------ fill-in-middle


def plain_fim(key, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", " ", "\n\t ", "a", " a", "a ", "one two  three\nfour ", "é ñ  漢字 \U0001f600 x", "<P> held", "a <S", "<M", "P> <",
    "x <S> y <M> z", "\x00 \x1f a", "w " * 3000, ("word " * 7 + "\n") * 500, "é" * 70_000 + " end", "    wide", "<<P <P",
]


def test_fill_in_middle_is_the_plain_one_and_comes_back(spark):
    rows = [(i * 1000 + j, t) for i, t in enumerate(TEXTS) for j in range(12)] + [(7, "again and again"), (7, "again and again"), (None, "no key here")]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back")
    got = got.select("doc_id", "text", "fim.*", back).collect()
    assert sorted((str(r.doc_id), r.text or "", *map(str, plain_fim(r.doc_id, r.text))) for r in got) == sorted(
        (str(r.doc_id), r.text or "", str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got
    )
    assert len(got) == len(rows) and all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", [1])], "doc_id long, text string, FIM string, cuts string, `a.b` array<int>")
    got = fim.transform(docs)
    assert got.columns == [*docs.columns, "fim_1"]
    assert got.drop("fim_1").collect() == docs.collect()
    assert fim.transform(docs.limit(0)).count() == 0
    assert free_name(["A", "a_1"], "a") == "a_2"


def test_parameters_of_the_forms(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = lambda **x: {r[0] for r in fim.transform(docs, **x).select("fim.form").distinct().collect()}
    assert forms(plain=0) == {"plain"} and forms(plain=100, spm=100) == {"spm"} and forms(plain=100, spm=0) == {"psm"}
    own = fim.transform(docs, plain=100, sentinels=("[p]", "[s]", "[m]"))
    text = fim.restore(F.col("fim.output"), F.col("fim.form"), ("[p]", "[s]", "[m]"))
    assert own.where(text != F.col("text")).count() == 0 and own.where(F.col("fim.output").contains("[m]")).count() == 200


def test_containers_select():
    rng = np.random.default_rng(5)
    sparse = np.unique(rng.integers(0, 65536, 900))
    dense = 65536 + np.unique(rng.integers(0, 65536, 30_000))
    runs = np.concatenate([3 * 65536 + np.arange(40, 9000), 3 * 65536 + np.arange(20_000, 65_536)])
    all_of = np.concatenate([sparse, dense, runs])
    held = fim.Boundaries(all_of)
    assert [type(c) for c in held.containers] == [fim.Array, fim.Bitmap, fim.Runs]
    assert len(held) == len(all_of) and [len(c) for c in held.containers] == [len(sparse), len(dense), len(runs)]
    at = np.unique(np.concatenate([[0, len(all_of) - 1], np.searchsorted(all_of, [65535, 65536, 3 * 65536]), rng.integers(0, len(all_of), 400)]))
    assert [held.select(int(i)) for i in at] == all_of[at].tolist()
    assert len(fim.Boundaries(np.empty(0, np.int64))) == 0


def test_boundaries_across_blocks(monkeypatch):
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fim, "BLOCK", block)
        for text in ("", " ", "a b  é漢 c\n", "é" * 50, "\U0001f600 \U0001f600 x "):
            ends = np.cumsum([len(u) for u in UNITS.findall(text)])
            assert fim.boundaries(text.encode()).tolist() == ends.tolist(), (block, text)


# ------------------------------------------------------------------ centroid clusters


def plain_clusters(rows, k, rounds, scale=256, dims=64):
    kept = [(i, [math.floor(float(c) * scale) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centres


def vectors(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((6, dims))
    return [(i, [float(np.float32(c)) for c in middles[i % 6] + rng.standard_normal(dims) * 0.2]) for i in range(n)]


def odd_vectors(rows):
    return [
        *rows, *rows[:5], (None, rows[3][1]), (None, rows[9][1]), (5000, None), (5001, [1.0] * 63), (5002, [1.0] * 65), (5003, [None] + [0.0] * 63),
        (5004, [NAN] + [0.0] * 63), (5005, [-INF] + [0.0] * 63), (5006, []), (5007, [0.0] * 64), (5008, [-0.001] * 64), (5009, [200.0] * 64),
    ]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"r": F.lit(1), "Cluster": F.lit("x"), "v": F.lit(2)})


def test_clusters_are_the_plain_ones(spark):
    rows = odd_vectors(vectors(1, 150))
    found, centres = centroids.clusters(table_of(spark, rows), k=12)
    want, middles = plain_clusters([(i, [np.float32(c) if c is not None else None for c in v] if v is not None else None) for i, v in rows], 12, 5)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == want
    assert centres.tolist() == middles
    told = {r.cluster: r for r in centroids.summary(found, centres).collect()}
    assert {c: sum(d for _, j, d in want if j == c) for c in told} == {c: r.cluster_inertia for c, r in told.items()}
    assert {r.inertia for r in told.values()} == {sum(d for *_, d in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest() for c, r in told.items())


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_any_number_of_bits_gives_the_same(spark, bits):
    rows = vectors(2, 60)
    want, _ = plain_clusters(rows, 7, 5)
    found, _ = centroids.clusters(table_of(spark, rows), k=7, bits=bits)
    assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == want


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, None)], vectors(3, 3), [(i, [0.5] * 64) for i in range(9)]):
        found, centres = centroids.clusters(table_of(spark, rows), k=5)
        want, middles = plain_clusters(rows, 5, 5)
        assert sorted((str(r.id), r.cluster, r.distance) for r in found.collect()) == want
        assert centres.tolist() == middles
        assert centroids.summary(found, centres).count() == len({c for _, c, _ in want})


def test_codes_pack_and_intervals_hold():
    rng = np.random.default_rng(4)
    v = np.floor(rng.standard_normal((500, 64)) * 40).astype(np.int64)
    c = np.concatenate([v[:20], v[:3]])
    exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    fetched = []
    for bits in (2, 5, 8):
        ends = [np.unique(np.quantile(v[:, d], np.linspace(0, 1, (1 << bits) + 1)[1:-1]).astype(np.int64)) for d in range(64)]
        ends = [e[e < v[:, d].max()] for d, e in enumerate(ends)]
        cells = centroids.Cells(ends, v.min(axis=0), v.max(axis=0), np.median(v, axis=0).astype(np.int64), bits)
        codes = cells.codes(v)
        assert (centroids.unpacked(centroids.packed(codes, bits), 64, bits) == codes).all()
        low, high = cells.table(c)
        least, most = (cells.norms(v)[:, None] + sum(t[d, codes[:, d]] for d in range(64)) for t in (low, high))
        assert (least <= exact).all() and (exact <= most).all()
        apart, best = centroids.left(codes, cells.norms(v), low, high)
        some = centroids.candidates(cells, c)(codes, cells.norms(v))
        assert (most[np.arange(500), best] == most.min(axis=1)).all() and not (some & ~apart).any()
        nearest = exact == exact.min(axis=1, keepdims=True)
        assert some[nearest].all()  # ties too
        alone = nearest.sum(axis=1) == 1
        fetched.append(tuple((x.sum(axis=1) > 1)[alone].mean() for x in (apart, some)))
    assert all(f[1] <= f[0] for f in fetched) and fetched[0][1] > fetched[1][1] > fetched[2][1] and fetched[2][1] < 0.2


def test_later_rounds_fetch_few_vectors_of_clear_clusters(spark):
    rows = vectors(6, 400)
    v = centroids.integers(table_of(spark, rows), "vec_id", F.col("embedding"), 64, 256)
    cells = centroids.cells_of(v, 64, 7)
    middles = np.array([np.floor(np.mean([256 * np.array(x) for i, x in rows if i % 6 == j], axis=0)) for j in range(6)]).astype(np.int64)
    approx = centroids.approximations(v, cells)
    assert centroids.to_fetch(approx, cells, middles, middles + 1).count() == 0
    swapped = middles[[1, 0, 2, 3, 4, 5]]
    assert centroids.to_fetch(approx, cells, middles, swapped).count() == sum(i % 6 < 2 for i, _ in rows)


# ------------------------------------------------------------------ decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(docs, items, width=10):
    windows = {}
    for key, text in items:
        w = low_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(key)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = low_words(text)
        spans = sorted((i, n) for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows)
        hit = {p for i, n in spans for p in range(i, i + n)}
        named = sorted({str(k) for i, n in spans for k in windows[tuple(w[i : i + n])] if k is not None})
        out.append((str(key), len(w), len(hit), spans, named))
    return sorted(out)


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"found": F.lit(1), "r": F.lit(2), "H": F.lit("z")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"w": F.lit(1), "n": F.lit("x")})
    got = winnow.find(d, i, **options).collect()
    return sorted((str(r.id), r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in got)


def leak_corpus(seed, vocabulary, n_docs=60, n_items=14):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([9, 10, 11, 25, 40]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        t = text(rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            t[rng.randrange(len(t) + 1) : 0] = source[a : a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(t).replace("a", rng.choice("aA"))))
    return docs, items


@pytest.mark.parametrize("seed,vocabulary", [(1, [f"w{i}" for i in range(300)]), (2, ["a", "b", "c"]), (3, ["aé", "ñ", "漢", "x1"]), (4, ["a"])])
def test_leaks_are_the_plain_ones(spark, seed, vocabulary):
    docs, items = leak_corpus(seed, vocabulary)
    assert leaks(spark, docs, items) == plain_leaks(docs, items)


def test_other_widths(spark):
    docs, items = leak_corpus(7, ["a", "b", "c", "d"], 30, 6)
    for width, gram in ((4, 2), (6, 6), (3, 1)):
        assert leaks(spark, docs, items, width=width, gram=gram) == plain_leaks(docs, items, width)


def test_odd_items_and_documents(spark):
    long = " ".join(f"t{i}" for i in range(40))
    items = [(1, long), (1, "second row of item one"), (2, None), (3, ""), (4, "..."), (5, "single"), (None, "no key but nine words to hit here now"), (6, long), (7, "two words"), (7, "two words")]
    docs = [
        (1, None), (2, ""), (3, "!?"), (4, "Single"), (5, "xsingle"), (5, "xsingle"), (6, "two, Words two words"), (None, long), (None, long), (7, long.upper() + " " + long),
        (8, "no key but nine words to hit here now"), (9, " ".join(long.split()[:9])), (10, " ".join(long.split()[:10])), (11, "second row of item one"),
        (12, "filler " * 50_000 + long + " filler" * 50_000),
    ]
    got = leaks(spark, docs, items)
    assert got == plain_leaks(docs, items)
    by = {k: r for k, *r in got}
    assert by["9"][1] == 0 and by["10"][1] == 10 and by["8"][1:] == [9, [(0, 9)], []]
    assert leaks(spark, [], items) == [] and all(r[2] == 0 for r in leaks(spark, docs, []))


def test_every_shared_window_has_a_common_fingerprint():
    rng = np.random.default_rng(9)
    for size in (3, 50):
        words = rng.integers(0, size, 400).astype(np.uint64)
        words = winnow.mix64(words)
        prints = winnow.fingerprints(words, 10, 5)
        places = winnow.last_places(words, np.arange(len(prints)), 10, 5)
        runs = winnow.run_hashes(words, 5)
        for i in range(len(prints)):
            own = runs[i : i + 6].tolist()
            assert prints[i] == min(own) and places[i] == i + max(j for j in range(6) if own[j] == min(own))
            alone = winnow.fingerprints(words[i : i + 10], 10, 5)
            assert alone.tolist() == [prints[i]]
    assert len(winnow.fingerprints(words[:9], 10, 5)) == 0


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    docs, items = leak_corpus(11, [f"w{i}" for i in range(50)])
    monkeypatch.setattr(winnow, "LEAST_BITS", 6)
    monkeypatch.setattr(winnow, "MOST_BITS", 6)
    assert leaks(spark, docs, items) == plain_leaks(docs, items)
