"""Toxicity by two class-conditional Kneser-Ney models.

The models run over the bytes of words (ASCII letters lower-cased, words end at anything that is no letter or digit):
a byte given the five before it in its word, with a mark before and after the word. Each class has its own counts of
six-byte grams; what they leave by absolute discounting goes to one shared backoff, Kneser-Ney over the five- and
three-byte endings, counted by the distinct grams of both classes together. So an expression that is rare in a class
is smoothed by what all texts know of its spelling.

A word's evidence is the log-likelihood of the toxic model less that of the ordinary one; a text is judged by the
length-normalised difference and by how its strongest words stand out (`FEATURES`). A logistic curve over these turns
them into a score; it is fitted on a sample of at most about `CALIBRATION` labelled rows, each scored without its own
counts. The counts themselves cover every labelled row.

The model's size is fixed: gram counts are folded into tables of `BUCKETS` cells by a hash, so a broadcast is some 50 MB
whatever the corpus holds; two grams that share a cell share their counts. Every Python worker of an executor holds a
copy, and what it needs beside it is bounded by `GRAMS_AT_ONCE`.

Defined cases: null and empty texts, and texts without words, are scored from the empty features (near the share of
toxic rows); words with digits (numbers, keys) carry no evidence; labels other than 0 and 1 and labels without key
teach nothing; of several labels of a key the largest counts; without rows of either class every score is 0.5; an
empty table gives an empty result; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codesift.llm.common import _LOWER, NOT_ALNUM, apart, maybe_in, mix64, ranges, slices, stored, word_hashes, word_spans

BUCKETS = 1 << 20
CALIBRATION = 10_000
#: Grams that are scored at a time: some 20 arrays of 8 bytes each.
GRAMS_AT_ONCE = 100_000
THRESHOLD = 0.3
DISCOUNT = 0.75
FEATURES = ("mean", "best", "second", "top five", "share over 3", "log words")

#: The folded tables. `top`, `ctx` and `typ` hold a column for each class.
TOP, CTX, TYP, END5, CTX5, TYP5, END3, CTX3, TYP3, BYTE = range(10)
MASK = {5: (1 << 40) - 1, 3: (1 << 24) - 1}


def cell(keys: np.ndarray, table: int) -> np.ndarray:
    salt = np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix64(keys.astype(np.uint64) ^ salt) % np.uint64(BUCKETS)).astype(np.int64)


def word_grams(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit grams of words (byte ranges of `data`), the end mark's included, and the word of each."""
    n = last - first + 1
    word = np.repeat(np.arange(len(first)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    source = first[word] + at
    low = _LOWER[data].astype(np.uint64)
    gram = np.where(at < n[word] - 1, low[source], np.uint64(1))
    for k in range(1, 6):
        before = np.where(at >= k, low[np.maximum(source - k, 0)], np.uint64(2))
        gram |= before << np.uint64(8 * k)
    return gram.astype(np.int64), word


class Words:
    """The words of some texts: which distinct word stands where, and the grams of the distinct words."""

    def __init__(self, texts: list[str | None]):
        hashes, self.offsets = word_hashes(texts, NOT_ALNUM)
        data, first, last = word_spans(texts, NOT_ALNUM)
        _, index, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.data, self.first, self.last = data, first[index], last[index]
        digits = np.concatenate(([0], np.cumsum((data >= 48) & (data < 58))))
        self.plain = digits[self.last] == digits[self.first]

    def __len__(self) -> int:
        return len(self.first)

    def parts(self, most: int = 500_000):
        """Ranges of distinct words with a bounded number of grams (a longer word stands alone)."""
        ends = np.cumsum(self.last - self.first + 1)
        start = 0
        while start < len(self):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield start, stop, *word_grams(self.data, self.first[start:stop], self.last[start:stop])
            start = stop


def _count(batches):
    """(text, toxic) -> (gram, toxic count, ordinary count), summed within a slice of texts."""
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
        for a, b in slices(texts):
            words = Words(texts[a:b])
            label = np.repeat(toxic[a:b], np.diff(words.offsets))
            times = np.stack([np.bincount(words.which, weights=label == c, minlength=len(words)) for c in (1, 0)])
            times = (times * words.plain).astype(np.int64)
            for start, stop, grams, word in words.parts():
                distinct, which = np.unique(grams, return_inverse=True)
                n = [np.bincount(which, weights=t[start:stop][word], minlength=len(distinct)).astype(np.int64) for t in times]
                some = n[0] + n[1] > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (distinct, *n)], ["gram", "t", "o"])


def _fold(endings: int):
    """Distinct grams (endings 6) or endings -> (tab, cell, t, o), what they add to the tables."""

    def entries(gram, t, o):
        ones, none = np.ones(len(gram), np.int64), np.zeros(len(gram), np.int64)
        if endings == 6:
            yield TOP, cell(gram, TOP), t, o
            yield CTX, cell(gram >> 8, CTX), t, o
            yield TYP, cell(gram >> 8, CTX), (t > 0).astype(np.int64), (o > 0).astype(np.int64)
            yield BYTE, gram & 255, ones, none
            for k, end, ctx in ((5, END5, CTX5), (3, END3, CTX3)):
                yield end, cell(gram & MASK[k], end), ones, none
                yield ctx, cell((gram & MASK[k]) >> 8, ctx), ones, none
        else:
            ctx, typ = (CTX5, TYP5) if endings == 5 else (CTX3, TYP3)
            yield typ, cell(gram >> 8, ctx), ones, none

    def run(batches):
        for batch in batches:
            gram, t, o = (c.to_numpy() for c in batch.columns)
            for tab, cells, x, y in entries(gram, t, o):
                distinct, which = np.unique(cells, return_inverse=True)
                x, y = (np.bincount(which, weights=v).astype(np.int64) for v in (x, y))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(distinct), tab, np.int32)), pa.array(distinct), pa.array(x), pa.array(y)],
                    ["tab", "cell", "t", "o"],
                )

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    cells, counts = pdf["cell"].to_numpy(np.int32), pdf[["t", "o"]].to_numpy(np.float32)
    return pd.DataFrame({"tab": [int(pdf["tab"].iloc[0])], "cells": [cells.tobytes()], "counts": [counts.tobytes()]})


def count_tables(labelled: DataFrame) -> np.ndarray:
    """The folded tables from (text, toxic) rows: an array (table, class, cell) of fixed size."""
    spark = labelled.sparkSession
    counted = labelled.mapInArrow(_count, "gram long, t long, o long")
    grams = stored(counted.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    schema = "tab int, cell long, t long, o long"
    parts = grams.mapInArrow(_fold(6), schema)
    for k in (5, 3):
        endings = grams.select(F.col("gram").bitwiseAND(F.lit(MASK[k])).alias("gram")).distinct()
        parts = parts.union(endings.select("gram", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("o")).mapInArrow(_fold(k), schema))
    cells = parts.groupBy("tab", "cell").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    packed = cells.groupBy("tab", F.shiftright("cell", 15).alias("shard")).applyInPandas(_pack, "tab int, cells binary, counts binary")
    tables = np.zeros((10, 2, BUCKETS), dtype=np.float32)
    for r in packed.toLocalIterator():  # at most 10 tables of 32 shards, by the tables' fixed size
        at = np.frombuffer(r.cells, np.int32)
        tables[r.tab][:, at] = np.frombuffer(r.counts, np.float32).reshape(-1, 2).T
    return tables


def handed_out(tables: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The columns of the tables that hold anything, by table and class: what the workers get."""
    columns = ((t, c) for t in range(len(tables)) for c in ((0, 1) if t in (TOP, CTX, TYP) else (0,)))
    return {(t, c): tables[t, c, :256] if t == BYTE else tables[t, c] for t, c in columns}


def shared_backoff(tables: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Probability of each gram's last byte by the endings that both classes share."""
    byte = tables[BYTE, 0]
    p = (byte[grams & 255] + 1) / (byte[:256].sum() + 256)
    for k, end, ctx, typ in ((3, END3, CTX3, TYP3), (5, END5, CTX5, TYP5)):
        tail = grams & MASK[k]
        at = cell(tail >> 8, ctx)
        total, types = tables[ctx, 0][at], tables[typ, 0][at]
        n = tables[end, 0][cell(tail, end)]
        held = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(n - DISCOUNT, 0) / held + DISCOUNT * np.minimum(types, total) / held * p, p)
    return p


def evidence(tables: np.ndarray, words: Words, own: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood difference of each distinct word; `own` (class, word) counts are taken off the tables' first."""
    out = np.zeros(len(words))
    for start, stop, grams, word in words.parts(GRAMS_AT_ONCE):
        backoff = shared_backoff(tables, grams)
        top, ctx = cell(grams, TOP), cell(grams >> 8, CTX)
        logs = []
        for c in (0, 1):
            n, total, types = tables[TOP, c][top], tables[CTX, c][ctx], tables[TYP, c][ctx]
            if own is not None:
                _, which = np.unique(top, return_inverse=True)
                n = np.maximum(n - np.bincount(which, weights=own[c, start:stop][word])[which], 0)
                _, which = np.unique(ctx, return_inverse=True)
                total = np.maximum(total - np.bincount(which, weights=own[c, start:stop][word])[which], 0)
                types = np.minimum(types, total)
            held = np.maximum(total, 1)
            p = np.maximum(n - DISCOUNT, 0) / held + DISCOUNT * types / held * backoff
            logs.append(np.log(np.where((total > 0) & (p > 0), p, backoff)))
        out[start:stop] = np.bincount(word, weights=logs[0] - logs[1], minlength=stop - start)
    return out * words.plain


def features(words: Words, value: np.ndarray) -> np.ndarray:
    """A row of `FEATURES` for each text."""
    n = np.diff(words.offsets)
    out = np.zeros((len(n), len(FEATURES)))
    text = np.repeat(np.arange(len(n)), n)
    x = value[words.which]
    x = x[np.lexsort((-x, text))]  # each text's words, strongest first
    start = words.offsets[:-1]
    some = n > 0
    out[:, 0] = np.bincount(text, weights=x, minlength=len(n)) / np.maximum(n, 1)
    out[some, 1] = x[start[some]]
    out[some, 2] = x[(start + np.minimum(1, n - 1))[some]]
    sums = np.concatenate(([0], np.cumsum(x)))
    five = np.minimum(5, n)
    out[:, 3] = (sums[start + five] - sums[start]) / np.maximum(five, 1)
    out[:, 4] = np.bincount(text, weights=x > 3, minlength=len(n)) / np.maximum(n, 1)
    out[:, 5] = np.log1p(n)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method: weights of the features, then the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    hold = ridge * len(y) * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic"):
    """Tables and curve from the labelled rows of `docs` whose key satisfies `learn` (a column over `key`)."""
    taught = labels.select(F.col(key).alias("k"), F.col(label).cast("long").alias("toxic")).where("toxic in (0, 1) and k is not null")
    taught = stored(taught.groupBy("k").agg(F.max("toxic").alias("toxic")))
    body = docs.where(learn).select(F.col(key).alias("k"), F.col(text).alias("text"))
    # Labels grow with the corpus, so the join is shuffled at every size; a bitmap spares most unlabelled texts the way.
    tables = count_tables(maybe_in(body, taught).join(taught.hint("merge"), "k").select("text", "toxic"))
    # The curve's sample: a seeded part of the labelled keys, at most about CALIBRATION of them, so it is broadcast.
    part = min(1.0, CALIBRATION / max(1, taught.count()))
    sample = taught.where(F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(1 << 20)) < int(part * (1 << 20)))
    handed = docs.sparkSession.sparkContext.broadcast(handed_out(tables))

    def alone(batches):
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for t, y in zip(texts, toxic):
                words = Words([t])
                times = np.bincount(words.which, minlength=len(words)) * words.plain
                own = np.stack([times * (y == 1), times * (y == 0)])
                rows.append(np.append(features(words, evidence(handed.value, words, own))[0], y))
            table = np.array(rows).reshape(len(rows), len(FEATURES) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], [f"f{i}" for i in range(table.shape[1])])

    schema = ", ".join(f"f{i} double" for i in range(len(FEATURES) + 1))
    seen = body.join(F.broadcast(sample), "k").select("text", "toxic").mapInArrow(alone, schema).toPandas().to_numpy()
    seen = seen[np.lexsort(seen.T)]  # the fit does not depend on the order of rows
    both = len(seen) and 0 < seen[:, -1].mean() < 1
    curve = fit_curve(seen[:, :-1], seen[:, -1]) if both else np.zeros(len(FEATURES) + 1)
    return handed, curve


@apart
def with_score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """`docs` with `__score`, between 0 and 1, for every row."""
    handed, curve = model
    at = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())

    def run(batches):
        for batch in batches:
            column, found = batch.column(at), [np.empty(0)]
            for a, b in ranges(pc.binary_length(column).to_pylist()):
                words = Words(column.slice(a, b - a).to_pylist())
                x = features(words, evidence(handed.value, words))
                found.append(1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -500, 500))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found))], [*batch.schema.names, "__score"]
            )

    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


@apart
def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with `__score`, learned from the labelled rows that are not held out."""
    return with_score(docs, train(docs, labels, ~held_out(F.col("doc_id"))))


@apart
def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score `threshold` or more."""
    return score_documents(docs, labels).where(F.col("__score") < threshold).drop("__score")


def op4(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    score = F.col("__score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )
