"""Benchmark decontamination by winnowing.

A window is `width` consecutive words of a benchmark item; an item of fewer words is one window. Of the hashes of all
`gram`-word runs inside a stretch of `width` words the smallest is kept (the last one of equal ones). Which one that is
depends on the stretch's words alone, so a stretch that document and item share has the same fingerprint at the same
place in both: every shared window is found, and about 2 of `width - gram + 2` runs are fingerprints.

1. The items' fingerprints, each with the hashes of the windows that it stands for. A bitmap of the fingerprints (bits
   by their number, between 2^16 and 2^26) goes to the tasks.
2. One pass over the documents, a narrow one: words, fingerprints, and of those that the bitmap lets through the windows
   around them. Most documents leave nothing but their number of words.
3. Fingerprints join fingerprints; then the hits are extended: every window that a joined fingerprint stands for joins
   the distinct windows of the items, so a row becomes one row at most, however many items share a passage.
4. The windows of a document give its hit words; its set of windows gives its items. Items are looked up once for each
   distinct set, so a passage in a third of all documents meets its items once.

Items shorter than `width` are fingerprints of their own length, looked up at every word for the lengths that occur
(fewer than `width`). Windows are told apart by two 64-bit hashes, of the window and of its fingerprint.

Defined cases: null and empty texts have no words; an item without words has no windows; a null item key counts for hit
words, but is no item in the list; rows of one item key are one item with the windows of all its rows; every row of
documents has its own result, null and repeated keys too; an empty benchmark leaves all documents clean; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import _MULT, NOT_ALNUM, mix64, slices, stored, word_hashes

#: Words of a window, and of the runs that are hashed: any common window holds WIDTH - GRAM + 1 of these.
WIDTH, GRAM = 10, 5
#: Bits of the bitmap for each fingerprint, and the powers of two between which its size stays.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 26
_STEP = np.uint64(0x9E6C63D0876A9A47)

_FOUND = "array<struct<h: long, n: int, first: int, windows: array<long>>>"


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of `n` word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _STEP + words[j : j + len(out)]
        return mix64(out + np.uint64(n) * _MULT)


def fingerprints(words: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each stretch of `width` words the smallest hash of its `gram`-word runs."""
    runs = run_hashes(words, gram)
    n = max(0, len(words) - width + 1)
    out = runs[:n]
    for j in range(1, width - gram + 1):
        out = np.minimum(out, runs[j : j + n])
    return out


def last_places(words: np.ndarray, starts: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Where the fingerprints of the stretches at `starts` stand: the last place of the smallest hash."""
    around = words[starts[:, None] + np.arange(width)].ravel()
    runs = np.append(run_hashes(around, gram), np.zeros(gram - 1, np.uint64)).reshape(len(starts), width)
    return starts + (width - gram) - np.argmin(runs[:, width - gram :: -1], axis=1)


def windows_of(texts: list[str | None], width: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item its window length (0 without words), the fingerprints and the hashes of its windows."""
    for a, b in slices(texts):
        words, at = word_hashes(texts[a:b], NOT_ALNUM)
        for i in range(b - a):
            own = words[at[i] : at[i + 1]]
            n = min(width, len(own))
            hashes = run_hashes(own, n) if n else np.empty(0, np.uint64)
            yield n, fingerprints(own, width, gram) if n == width else hashes, hashes


def _item_windows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, (n, prints, hashes) in zip(keys, windows_of(texts, width, gram)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(hashes), pa.string()), pa.array([n] * len(hashes), pa.int32()),
                     pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64))], ["item", "n", "h", "w"]
                )

    return run


def _place(h, bits: int):
    """The bit of a hash: its upper `bits` bits."""
    return h >> np.uint64(64 - bits)


def _likely(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = _place(hashes, bits)
    return np.flatnonzero((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _document_windows(bitmap: np.ndarray, bits: int, lengths: list[int], width: int, gram: int):
    """(id, text) -> (id, n_words, found): the likely fingerprints, each with the windows around it."""

    def found_in(words: np.ndarray, at: np.ndarray):
        """Columns of the fingerprints: row of the text, hash, length, first window; and the windows' number and hashes."""
        row, h, n, first, count, hashes = ([] for _ in range(6))
        for length in [*lengths, width]:
            prints = fingerprints(words, width, gram) if length == width else run_hashes(words, length)
            starts = _likely(prints, bitmap, bits)
            of = np.searchsorted(at, starts, side="right") - 1
            inside = starts + length <= at[of + 1]
            starts, of = starts[inside], of[inside]
            if not len(starts):
                continue
            if length == width:
                places = last_places(words, starts, width, gram)
                whole = run_hashes(words[starts[:, None] + np.arange(width)].ravel(), width)[::width]
                # Windows of one fingerprint are neighbours.
                new = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0))
            else:
                whole, new = prints[starts], np.arange(len(starts))
            row.append(of[new])
            h.append(prints[starts[new]])
            n.append(np.full(len(new), length))
            first.append((starts - at[of])[new])
            count.append(np.diff(new, append=len(starts)))
            hashes.append(whole)
        return [np.concatenate([*x, np.empty(0, t)]).astype(t) for x, t in
                ((row, int), (h, np.uint64), (n, np.int32), (first, np.int32), (count, int), (hashes, np.uint64))]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                words, at = word_hashes(texts[a:b], NOT_ALNUM)
                row, h, n, first, count, hashes = found_in(words, at)
                order = np.argsort(row, kind="stable")
                parts = np.split(hashes, np.cumsum(count)[:-1]) if len(count) else []
                ends = np.concatenate(([0], np.cumsum(count[order]))).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *(parts[i] for i in order)]).view(np.int64)
                prints = pa.StructArray.from_arrays(
                    [pa.array(h[order].view(np.int64)), pa.array(n[order]), pa.array(first[order]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["h", "n", "first", "windows"]
                )
                rows = np.searchsorted(row[order], np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(rows), prints)],
                    ["id", "n_words", "found"],
                )

    return run


def bitmap_of(prints: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes `h` and its number of bits as a power of two; 8 MB at most, whatever their number."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(1 + BITS_EACH * prints.count()))))
    place = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    words = prints.select(place.alias("p")).select(F.shiftright("p", 6).alias("at"), bit.alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("b")).toLocalIterator():
        out[r["at"]] = r["b"]
    return out.view(np.uint8), bits


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    width: int = WIDTH,
    gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for every row of `docs`, its key as `id`.

    `spans`: where windows of items start in the text and how many words they have, in order; `items`: the keys of the
    items with such windows, as strings in order.
    """
    listed = items.select(F.col(f"`{item_key}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    windows = stored(listed.mapInArrow(_item_windows(width, gram), "item string, n int, h long, w long").distinct())
    prints = stored(windows.select("h").distinct())
    bitmap, bits = bitmap_of(prints)
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < width).select("n").distinct().collect())  # fewer than `width`
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    scanned = body.mapInArrow(
        _document_windows(bitmap, bits, lengths, width, gram), f"id {body.schema['id'].dataType.simpleString()}, n_words long, found {_FOUND}"
    )
    rows = stored(scanned.withColumn("r", F.monotonically_increasing_id()))  # written, so that the numbers stay
    likely = rows.select("r", F.explode("found").alias("f")).select("r", "f.*")
    joined = likely.join(prints, "h", "left_semi")
    around = joined.select("r", "h", "n", "first", F.posexplode("windows").alias("i", "w"))
    hits = around.join(windows.select("h", "w", "n").distinct(), ["h", "w", "n"], "left_semi")
    span = F.struct((F.col("first") + F.col("i")).alias("at"), "n")
    found = hits.groupBy("r").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.collect_set(F.struct("h", "w", "n"))).alias("set")
    )
    # One pass over the spans in order: words behind the last end count.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def add(got, one):
        end = one["at"] + one["n"]
        return F.struct(F.greatest(got["end"], end).alias("end"), (got["hit"] + F.greatest(end - F.greatest(got["end"], one["at"]), F.lit(0))).alias("hit"))

    found = stored(
        found.select(
            "r", "spans", "set", F.aggregate("spans", start, add)["hit"].alias("n_hit"),
            F.xxhash64("set").alias("s1"), F.xxhash64(F.lit(7), "set").alias("s2"),
        )
    )
    sets = found.groupBy("s1", "s2").agg(F.first("set").alias("set")).select("s1", "s2", F.explode("set").alias("x")).select("s1", "s2", "x.*")
    named = sets.join(windows, ["h", "w", "n"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = found.join(named, ["s1", "s2"]).select("r", "n_hit", "spans", "items")
    none = F.array().cast("array<string>"), F.array().cast("array<struct<at: int, n: int>>")
    return (
        rows.select("r", "id", "n_words")
        .join(told, "r", "left")
        .select(
            "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("spans", none[1]).alias("spans"), F.coalesce("items", none[0]).alias("items"),
        )
    )


def op13(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find(docs, items).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM item_words)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, d.n, item_id FROM doc_windows d JOIN item_windows b ON d.s = b.s AND d.n = b.n),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
