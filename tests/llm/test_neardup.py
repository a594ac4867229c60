"""Near duplicates against brute force over all pairs, with odd rows and large groups."""

import random
import re

from codesift.llm import neardup
from codesift.llm.neardup import components, keep_one, near_duplicates

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=40)
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 30, 80, 200]))
        if rng.random() < 0.5:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
            n += 1
    rng.shuffle(rows)
    return rows


def found(df, **options):
    return {r.id: (r.n, r.comp) for r in near_duplicates(df, **options).collect()}


def test_components_are_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "x " * 20000), (907, "X " * 20001)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    for width in (4, 5):
        assert found(df, width=width) == brute(rows, width)


def test_chain_of_edits_and_star(spark):
    """A chain whose ends are unlike, and copies that are like their base but not like each other."""
    words = [f"v{i}" for i in range(120)]
    chain = [(i, " ".join(["a%d" % j for j in range(4 * i)] + words[4 * i :])) for i in range(12)]
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    star = [(500, " ".join(base))]
    for i in range(30):
        edited = list(base)
        for p in rng.sample(range(200), 4):
            edited[p] = f"c{i}_{p}"
        star.append((501 + i, " ".join(edited)))
    rows = chain + star
    assert found(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA), width=4) == brute(rows, 4)


def test_repeated_keys_nulls_and_kept_rows(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "p"), (1, "quite another text of some words", "q"), (2, text.upper(), "r"), (3, "other words entirely here", "s"), (None, text, "t"), (2, text, "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id or 0, r.comp or 0) for r in near_duplicates(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (3, 3)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, "t"), (1, "p"), (1, "q"), (3, "s")]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_query_is_registered():
    from codesift.llm.queries import QUERIES

    assert QUERIES["op6_near_duplicates"][1] is neardup.ORACLE
