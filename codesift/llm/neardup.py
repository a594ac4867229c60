"""MinHash near-dedup by bottom-k sketches from one hash function.

A document is the set of its distinct word shingles, as 64-bit hashes. Its sketch is the `K` smallest of them, or the
whole set up to `WHOLE` shingles: a set that is similar enough to one of at most K has no more.

1. Texts with the same word sequence are one class; its smallest document stands for it.
2. Inverted lists: a retained value with the classes that retain it. Two whole sets share `percent` of the larger one
   at least; of two sketches of K, as many as `DEVIATIONS` below the mean, but for a chance of about 1e-9. So a class enters only the lists of its
   rarest `s - needed + 1` values, in the order of frequency, and two classes that share enough meet in one of these.
   Lists of one are left out, and passages of many documents, being frequent, are seldom among the rarest.
3. Star: in each list every class meets the list's centre only, the class whose values are the most shared. This
   takes a group of thousands of near copies to one component without its pairs.
4. Rest: lists whose classes are still in different components are open. A sketch's bound is loose by its deviations,
   and the members of a group of near copies that are not similar to each other would all meet through it. So the
   classes of open lists (a small part) get their whole sets as retained values, in lists of their own, where the bounds
   are exact: a class enters with the values that it may be the first to share, rarest first, and two meet only if
   what both have left from the value on is as much as they have to share. At least one of them must stand beside its
   list's main component. Of near copies the own values come first and the common ones late, with too little left, so
   unlike members do not meet. A long list is split between tasks by Spark's skew handling.
5. Pairs are kept if their sizes allow the similarity and the union sketch (the `UNION` smallest of both sketches)
   estimates it to be `LIKELY` at least; then the exact Jaccard of the full sets decides.
6. Components of the confirmed links, by smallest label with pointer jumping.

Defined cases: null and empty texts, and texts without words, have an empty set, link with nothing and are their own
component; fewer words than `width` make one shingle of the whole sequence; rows with the same key are one document,
so they share a component, each with its own text's size; a row with a null key is never linked and stays; keys are
integers, and a key column of another type is an error before anything runs; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.llm.common import _MULT, apart, maybe_in, mix64, slices, stored, word_hashes

#: Values of a sketch, the largest set that is kept whole, and the standard deviations by which two sketches of similar
#: sets may have less in common than expected.
K, WHOLE, DEVIATIONS = 160, 200, 7.0
#: Values of the union sketch (by 31 bits of their hashes), and the common share of them that a likely pair has.
UNION, LIKELY = 64, 0.4


def shingle_hashes(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: its word hashes and its sorted distinct shingle hashes."""
    for a, b in slices(texts):
        words, at = word_hashes(texts[a:b])
        n = max(0, len(words) - width + 1)
        grams = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                grams = mix64(grams * _MULT + words[j : j + n])
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= width:
                yield words[lo:hi], np.unique(grams[lo : hi - width + 1])
            else:  # the whole sequence is one shingle, if there is a word
                h = np.zeros(min(1, hi - lo), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        h = mix64(h * _MULT + w)
                yield words[lo:hi], h


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    """Arrays of unsigned values as lists of the signed ones with the same bits."""
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    values = np.concatenate([np.empty(0, parts[0].dtype if parts else kind), *parts]).view(kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _sequence(words: np.ndarray) -> bytes | None:
    """128 bits of a word sequence: two sums of hashes of word and place. None without words."""
    if not len(words):
        return None
    place = mix64(np.arange(len(words), dtype=np.uint64))
    with np.errstate(over="ignore"):
        return np.array((mix64(words ^ place).sum(), mix64(words * _MULT + place).sum()), np.uint64).tobytes()


def _pieces(batches, rows: int = 500):
    """Batches cut to a bounded number of rows, so a task holds few texts and sets at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sequences(width: int):
    def run(batches):
        for batch in _pieces(batches):
            sizes, seqs = [], []
            for words, grams in shingle_hashes(batch.column(1).to_pylist(), width):
                sizes.append(len(grams))
                seqs.append(_sequence(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(seqs, pa.binary())], ["id", "n", "seq"]
            )

    return run


def _sketches(width: int):
    def run(batches):
        for batch in _pieces(batches):
            sizes, seqs, parts, short = [], [], [], []
            for words, grams in shingle_hashes(batch.column(1).to_pylist(), width):
                values = np.sort(mix64(grams))
                sizes.append(len(grams))
                seqs.append(_sequence(words))
                parts.append(values[: len(values) if len(values) <= WHOLE else K])
                short.append(np.unique(values[:UNION] >> np.uint64(33)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(seqs, pa.binary()), _lists(parts), _lists(short, np.int32)],
                ["id", "n", "seq", "sketch", "low"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in _pieces(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):  # a batch of sets for each bounded part of a batch of texts
                found = list(shingle_hashes(texts[a:b], width))
                seqs = pa.array([_sequence(words) for words, _ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([seqs, _lists([grams for _, grams in found])], ["seq", "grams"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, comp): the smallest id that is reachable. Every round is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("comp").alias("near"))
        )
        hooked = labels.join(near, "id").select("id", F.least("comp", "near").alias("new"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        after = stored(
            hooked.join(jump, "new", "left").select("id", F.coalesce(F.least("new", "far"), "new").alias("comp"), "was")
        )
        moved = after.where(F.col("comp") != F.col("was")).limit(1).count()
        labels = after.select("id", "comp")
        if not moved:
            return labels


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n, comp) for every row of `docs` with its key as `id`: set size and smallest reachable key."""
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of integers: components are named by the smallest key")
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = body.mapInArrow(_sequences(width), "id long, n long, seq binary")
    rows = stored(rows.withColumn("cls", F.xxhash64("seq")))
    linkable = rows.where(F.col("id").isNotNull() & F.col("seq").isNotNull())
    # One class for each word sequence, with its smallest document.
    sketched = body.mapInArrow(_sketches(width), "id long, n long, seq binary, sketch array<long>, low array<int>")
    classes = stored(
        sketched.where(F.col("id").isNotNull() & F.col("seq").isNotNull())
        .groupBy(F.xxhash64("seq").alias("cls"))
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("low").alias("low"))
    )
    # Whole sets and sketches of K have lists of their own; a class between K and WHOLE is in both.
    whole = classes.where(F.col("n") <= WHOLE).select("cls", F.lit(True).alias("w"), F.explode("sketch").alias("v"))
    cut = classes.where(F.col("n") > K).select("cls", F.lit(False).alias("w"), F.explode(F.slice("sketch", 1, K)).alias("v"))
    posted = whole.union(cut).repartition("w", "v")  # one shuffle for the counts and the lists
    shared = posted.groupBy("w", "v").agg(F.count("cls").alias("df")).where("df > 1")
    met = posted.join(shared, ["w", "v"]).join(classes.select("cls", "n"), "cls")
    # Lists of one are left out, but count among the rarest values of their class.
    own = Window.partitionBy("cls", "w")
    s = F.when(F.col("w"), F.col("n")).otherwise(K)

    def need(n: Column, m: Column) -> Column:
        """How many values of a list's kind sets of n and m have in common if they are similar enough."""
        common = (n + m) * percent / (100 + percent)
        share = F.least(common / F.greatest(n, m), F.lit(1.0))  # of the larger set; the smaller one's is no less
        sketched = F.floor(share * K - F.sqrt(share * (1 - share) * K) * DEVIATIONS)
        return F.when(F.col("w"), F.ceil(common)).otherwise(sketched)

    placed = met.select(
        "*",
        (F.row_number().over(own.orderBy("df", "v")) + s - F.count("*").over(own)).alias("place"),
        F.sum("df").over(own).alias("centrality"),
    )
    # From its place on, a class has `left` values; the fewest that any partner asks for is with the smallest one.
    ahead = placed.withColumn("left", s - F.col("place") + 1).withColumn("low", F.ceil(F.col("n") * percent / 100))
    lists = stored(ahead.where(F.col("left") >= need(F.col("n"), F.col("low"))).select("w", "v", "cls", "n", "left", "centrality"))

    def fits(n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def sets_of(reps: DataFrame) -> DataFrame:
        """(cls, grams): the whole sets of classes, each made once from its smallest document's text (`rep`)."""
        wanted = reps.select(F.col("rep").alias("k")).distinct()
        texts = maybe_in(body.withColumnRenamed("id", "k"), wanted).join(wanted, "k")
        made = texts.mapInArrow(_sets(width), "seq binary, grams array<long>")
        return stored(made.select(F.xxhash64("seq").alias("cls"), "grams").dropDuplicates(["cls"]))

    def confirmed(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of pairs (a, b) of classes, those whose estimate and then whose full sets are similar enough."""
        pairs = stored(pairs)
        some = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        low = stored(classes.select("cls", "low", "n", "rep").join(some, "cls", "left_semi"))
        a = low.select(F.col("cls").alias("a"), F.col("low").alias("la"), F.col("n").alias("na"), F.col("rep").alias("ra"))
        b = low.select(F.col("cls").alias("b"), F.col("low").alias("lb"), F.col("n").alias("nb"), F.col("rep").alias("rb"))
        union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, UNION)
        common = F.size(F.array_intersect(F.array_intersect(union, "la"), "lb"))
        likely = stored(
            pairs.join(a, "a").join(b, "b").where(common >= F.size(union) * LIKELY).select("a", "b", "na", "nb", "ra", "rb")
        )
        if sets is None:  # of the classes in a likely pair
            sets = sets_of(likely.select(F.col("ra").alias("rep")).union(likely.select("rb")))
        both = likely.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a").join(
            sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b"
        )
        inter = F.size(F.array_intersect("ga", "gb")).cast("long")
        return both.where(inter * 100 >= (F.col("na") + F.col("nb") - inter) * percent).select("a", "b")

    centre = lists.groupBy("w", "v").agg(F.max(F.struct("centrality", "cls", "n")).alias("c"))
    star = stored(
        lists.join(centre, ["w", "v"])
        .where((F.col("c.cls") != F.col("cls")) & fits(F.col("n"), F.col("c.n")))
        .select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"))
        .distinct()
    )
    star_links = stored(confirmed(star))
    # Classes of lists that reach into different components; `x` marks those beside a list's main component.
    split = lists.join(components(star_links).withColumnRenamed("id", "cls"), "cls", "left")
    split = split.withColumn("comp", F.coalesce("comp", "cls"))
    about = split.groupBy("w", "v").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least_n"),
        F.max(F.struct("centrality", "cls", "n", "comp")).alias("c"),
    )
    opened = about.where("lo <> hi").select("w", "v", "least_n", F.col("c.comp").alias("main"))
    smallest_n = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))
    # Of a sketch, less is asked for by smaller and by larger partners; of a whole set, by smaller ones.
    fewest = need(F.col("n"), F.when(F.col("w"), smallest_n).otherwise(F.ceil(F.col("n") * percent / 100)))
    beside = (F.col("comp") != F.col("main")) & (F.col("left") >= fewest)
    some = split.join(opened, ["w", "v"]).groupBy("cls", "n", "comp").agg(F.max(beside).alias("x"))
    some = stored(some.join(classes.select("cls", "rep"), "cls"))
    sets = sets_of(some)
    # Their whole sets as retained values: the same lists as above, with exact bounds.
    values = sets.select("cls", F.explode("grams").alias("v")).repartition("v")
    counted = values.groupBy("v").agg(F.count("cls").alias("df")).where("df > 1")
    of_class = Window.partitionBy("cls")
    place = F.row_number().over(of_class.orderBy("df", "v")) + F.col("n") - F.count("*").over(of_class)
    ranked = values.join(counted, "v").join(some.select("cls", "n", "comp", "x"), "cls").withColumn("left", F.col("n") - place + 1)

    def shared(n: Column, m: Column) -> Column:
        return F.ceil((n + m) * percent / (100 + percent))

    open_lists = stored(ranked.where(F.col("left") >= shared(F.col("n"), F.ceil(F.col("n") * percent / 100))).select("v", "cls", "n", "left", "comp", "x"))
    a = open_lists.where("x").select("v", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("left").alias("ea"), F.col("comp").alias("ca"))
    b = open_lists.select("v", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("left").alias("eb"), F.col("comp").alias("cb"))
    rest = (
        a.join(b, "v")
        .where((F.col("ca") != F.col("cb")) & fits(F.col("na"), F.col("nb")) & (F.least("ea", "eb") >= shared(F.col("na"), F.col("nb"))))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    # Rows with one key are one document, whatever their texts: their classes are linked too.
    member = linkable.select("id", "cls").distinct()
    twice = member.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("id", "a")
    same_key = member.join(twice, "id").select("a", F.col("cls").alias("b"))
    linked = components(star_links.union(confirmed(rest, sets)).union(same_key)).withColumnRenamed("id", "cls")
    labelled = classes.select("cls", "rep").join(linked, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = labelled.groupBy("comp").agg(F.min("rep").alias("least"))
    named = labelled.join(smallest, "comp").select("cls", "least")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    key_class = F.when(F.col("seq").isNotNull(), F.col("cls"))  # empty sets belong to no class
    return (
        rows.select("id", "n", key_class.alias("cls")).join(named, "cls", "left").select("id", "n", comp.alias("comp"))
    )


@apart
def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near duplicates, the one with the smallest key."""
    found = near_duplicates(docs, text, key, width, percent)
    gone = found.where(F.col("id") != F.col("comp")).select(F.col("id").alias("__id")).distinct()
    return docs.join(gone, F.col(key).cast("long") == F.col("__id"), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("comp").alias("component_id"),
        F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"),
    )


#: Links are found by the shared shingles of the pairs that have one; components by a recursive walk.
ORACLE = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM toks)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
