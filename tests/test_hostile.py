"""Patterns rewritten for linear time: same matches as the originals, and texts of blanks and unclosed openers."""

import random
import re
import time

import pytest

from codesift.functions.dialect import java_pattern, java_skip
from codesift.functions.lines import js_trim, match_skeleton
from codesift.rules import ALL_RULES
from pyspark.sql import functions as F

REWRITTEN = [r for r in ALL_RULES if r.skip_pattern or r.rule_id in ("SQL_INJECTION", "COOKIE_INSECURE", "EMPTY_CATCH")]
PARTS = {
    "PATH_TRAVERSAL": ["readFile", "readFileSync(", "(", ")", "req.", "x", " ", "body."],
    "NOSQL_INJECTION": ["find", "findOne(", "(", "{", "}", "req.body", "x", " ", "find({"],
    "CORS_ALL_ORIGINS": ["cors", "(", "{", "}", "origin", ": '*'", " ", "cors({", "x"],
    "SENSITIVE_DATA_LOG": ["console.log", "(", ")", "token", "x", " ", "console.log("],
    "SQL_INJECTION": ["'", '"', "select ", "from", "+", " ", "\n", "x", "+ "],
    "COOKIE_INSECURE": ["res.cookie(", "'a',", "b", ")", ";", "//", " ", "\n", "'',", ","],
    "EMPTY_CATCH": ["catch", "(", "e", ")", "{", "}", "//", " ", "\n", "x"],
    "MISSING_TIMEOUT": ["await fetch", "(", "u", ",", ")", "/*", "timeout", " ", "\n"],
    "SEQUENTIAL_ASYNC": ["for", "while", "(", ")", "{", "}", " await ", " ", "Of", "x"],
    "N_PLUS_ONE": ["for", "(", ")", "{", "}", " db.", " find(", " ", "await ", "x"],
    "STRING_CONCAT_LOOP": ["for", " ", "{", "}", "+=", "'", "s", "\n"],
}


@pytest.mark.parametrize("rule", REWRITTEN, ids=lambda r: r.rule_id)
def test_same_matches_as_the_original(rule):
    flags = re.I if "i" in rule.flags else 0
    original = re.compile(rule.pattern, flags)
    skip = f"|{rule.skip_pattern}" if rule.skip_pattern else ""
    safe = re.compile(f"({rule.safe_pattern or rule.pattern}){skip}", flags)
    rng, seen = random.Random(1), 0
    for _ in range(20000):
        text = "".join(rng.choices(PARTS[rule.rule_id], k=rng.randint(1, 24)))
        want = [m.span() for m in original.finditer(text)]
        assert [m.span() for m in safe.finditer(text) if m[1] is not None] == want, text
        seen += bool(want)
    assert seen > 20


N = 100_000
HOSTILE = {
    "blanks after fetch(": "await fetch(" + " " * N,
    "blanks in a cookie": "res.cookie('a'," + " " * N,
    "blanks after a cookie": "res.cookie('a', b)" + " " * N,
    "sql words": "'" + "select " * (N // 7),
    "blanks in catch": "catch(e){" + " " * N,
    "blanks in a catch comment": "catch(e){//" + " " * N,
    "open catch": "catch(" * (N // 6),
    "open for": "await += query for(" * (N // 19),
    "open while": "await while(" * (N // 12),
    "open fetch": "await fetch(" * (N // 12),
    "open readFile": "readFile(" * (N // 9),
    "open console": "console.log(" * (N // 12),
    "open find": "req. find({" * (N // 11),
    "open cors": "cors({" * (N // 6),
    "open forEach": ".forEach(" * (N // 9),
    "tabs": "\t" * N,
    "digits": "1" * N,
    "quoted digits": "'" + "1" * N,
    "slashes": "//" + " " * N,
}


def test_hostile_texts_are_fast(spark):
    df = spark.createDataFrame(list(HOSTILE.items()), "k string, t string").repartition(1).cache()
    marks = [F.length(match_skeleton(F.col("t"), java_pattern(r), java_skip(r))).alias(r.rule_id) for r in ALL_RULES]
    df.limit(0).select(*marks).collect()
    slow = {}
    for k in HOSTILE:
        start = time.time()
        df.where(F.col("k") == k).select(*marks).collect()
        if time.time() - start > 20:  # all 45 rules, on a machine that may be busy
            slow[k] = time.time() - start
    assert not slow


def test_trim_is_linear(spark):
    text = "﻿  a" + " " * 200_000 + "b \n"
    start = time.time()
    got = spark.createDataFrame([(text,), (" \t",), ("",)], "t string").select(js_trim(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["a" + " " * 200_000 + "b", "", ""] and time.time() - start < 10
