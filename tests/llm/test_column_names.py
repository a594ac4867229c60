"""Columns of the input that are named like the operators' own pass through, and results stay the same."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codesift.llm import fim, linededup, mixing, neardup, tokencount, toxicity, wfst
from codesift.llm.common import apart

#: Every name of the operators' own, and names that helpers may give.
NAMES = [
    "__row", "__gone", "__lines", "__m", "__b", "__p", "__k", "__r", "__mix", "__n", "__id", "__text", "__in", "__tokens", "__ids", "__decoded",
    "__score", "__at", "__w", "__bits", "aside0", "aside1", "id", "n", "comp", "cls", "seq", "k", "v", "text_1", "fim", "cuts", "found", "a.b", "c`d",
]
ROWS = [
    (1, "one two three four five six\nsame line\nx", "s1", "en", 1), (2, "one two three four five six\nsame line\nx", "s2", "en", 1),
    (3, "entirely other words stand in this text here", "s1", "en", 1), (4, None, None, "en", 1), (5, "", "s3", "en", 1), (6, "same line", "s3", "en", 1),
]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string, n_chars long")


def named(df, upper):
    extra = {(n.upper() if upper else n): F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES}
    return df.withColumns(extra), list(extra)


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (3, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "line_dedup": lambda d, s: linededup.dedup_lines(d, min_sites=2),
    "mix": lambda d, s: mixing.mix(d),
    "repeated": lambda d, s: mixing.repeated(d),
    "keep_one": lambda d, s: neardup.keep_one(d),
    "count_tokens": lambda d, s: tokencount.count_tokens(d),
    "encode": lambda d, s: wfst.encode(d, decoded=True),
    "score": lambda d, s: toxicity.score_documents(d, labels(s)),
    "drop_toxic": lambda d, s: toxicity.drop_toxic(d, labels(s), 0.6),
    "fill_in_middle": lambda d, s: fim.transform(d),
    "stage_lines": lambda d, s: corpus_pipeline.line_dedup_stage(s, d, ""),
    "stage_near": lambda d, s: corpus_pipeline.near_dedup_stage(s, d, ""),
    "stage_mixing": lambda d, s: corpus_pipeline.mixing_stage(s, d, ""),
}


def shown(rows, columns):
    return sorted(str([r[c] if not hasattr(r[c], "asDict") else r[c].asDict(recursive=True) for c in columns]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_pass_through(spark, name):
    plain = OPERATORS[name](docs(spark), spark)
    want = shown(plain.collect(), range(len(plain.columns)))
    for upper in (False, True):
        given, extra = named(docs(spark), upper)
        got = OPERATORS[name](given, spark)
        n = len(docs(spark).columns)
        assert got.columns[: n + len(extra)] == given.columns
        added = got.columns[n + len(extra) :]
        assert len(added) == len(plain.columns) - n and len({c.lower() for c in got.columns}) == len(got.columns)
        rows = got.collect()
        assert shown(rows, [*range(n), *range(n + len(extra), len(got.columns))]) == want
        for r in rows:
            assert all(r[n + i] == f"{x}{r['doc_id']}" for i, x in enumerate(NAMES))


def test_arguments_follow_and_nothing_else_changes(spark):
    given = docs(spark).select("doc_id", F.col("text").alias("__text"), F.col("source").alias("__SOURCE"))
    got = linededup.dedup_lines(given, text="__text", site="__SOURCE", min_sites=2)
    want = linededup.dedup_lines(docs(spark).select("doc_id", "text", "source"), min_sites=2)
    assert got.columns == ["doc_id", "__text", "__SOURCE", "__lines"]
    assert shown(got.collect(), range(4)) == shown(want.collect(), range(4))
    calls = []
    same = apart(lambda d: calls.append(d) or d)
    frame = docs(spark)
    assert same(frame) is frame and calls == [frame]
