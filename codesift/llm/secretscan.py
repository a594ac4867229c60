"""Secret scans with a random forest for false-positive removal (native).

A candidate is a run of at least `LEAST` characters of the alphabet of keys inside a word; what is assigned to, or
stands quoted after, a credential's name, from `SHORT` characters on; and the password of a URL (user:password@host).
That finds keys and passwords, and also long words, numbers, addresses and host names. A random forest over the
candidate's length, its character transitions, how much of it dictionary words cover, its path and its neighbouring
words tells them apart. The dictionary holds every word of the corpus that stands in it `SEEN` times or more; it is a
table, joined to the letters of the distinct candidates. The forest is trained on labelled findings:
given ones, or those that `weak_labels` can name from forms alone (keys of known issuers, assigned random values,
quoted values after a credential's name and URL passwords; mail addresses, plain words, numbers, host names,
placeholders), of which a seeded part of at most about `TRAINED` rows is used. What no form names is judged by the
forest alone. No feature holds an issuer's prefix.

A quoted value counts up to its first white space. A name and its value may be a word apart (name, sign, value). A
URL's password may be both a candidate and the start of a run of key characters; each is a finding.

Defined cases: null and empty texts have no candidates; a null path is an empty one; a candidate in several places is
a finding at each; repeated rows give repeated findings; without labelled findings of both kinds the labels decide
and the rest scores 0; an empty table gives no findings; words are split at white space, so a text of one very long
word is one word with all its candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import maybe_in, stored

LEAST = 16
SHORT = 4
SEEN = 3
TRAINED = 20_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 8, 11

CORE = rf"[A-Za-z0-9_+/.@\-]{{{LEAST},}}={{0,2}}"
#: Names and marks around credentials, and around examples. Fixed values of the features.
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
EXAMPLE = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|mock|fake|lorem)"
ISSUED = (
    r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_\-]{20}|xox[abpr]-[A-Za-z0-9\-]{10,}"
    r"|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})$"
)
#: A credential's name up to its value's sign, the sign, and values with and without quotes.
NAME = (
    r"(?i:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|auth(?!or)|bearer|credential|private[_-]?key)"
    r"[A-Za-z0-9_\-]*[\"'`\])]*"
)
SIGN = r"(?:=>|:=|==?|:)"
QUOTED = rf"[\"'`]([^\"'`\s]{{{SHORT},}})"
BARE = rf"([^\s\"'`,;()<>{{}}\[\]=][^\s\"'`,;()<>{{}}\[\]]{{{SHORT - 1},}})"
URL = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#:@\"'`]*:([^\s/?#\"'`]+)@"
#: Values that stand for one to be filled in.
BLANK = r"^[$<{%\[]|\*\*\*|\.\.\."
HARMLESS = (
    r"^([^@]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+|[A-Za-z]+([_.\-/][A-Za-z]+)*\.?|[0-9.\-/]+|[a-z0-9\-]+(\.[a-z0-9\-]+)*\.(com|org|net|io|edu)([/.].*)?)$"
)

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "distinct", "switches", "vowel_pairs", "longest_letters",
    "coverage", "credential_before", "assigned", "quoted", "example_near", "path_parts", "path_example", "mail", "dots", "in_url",
]


def share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def values(word: Column, before: Column) -> Column:
    """The candidates of a word: runs of key characters, then URL passwords and values of credentials beyond them."""
    def every(pattern: str) -> Column:
        return F.regexp_extract_all(word, F.lit(pattern), 1)

    none = F.array().cast("array<string>")
    core = F.when(F.length(word) >= LEAST, every(f"({CORE})")).otherwise(none)
    named, signed = before.rlike(f"{NAME}$"), before.rlike(rf"{NAME}\s*{SIGN}$")
    short = F.concat(
        F.when(word.rlike(NAME), F.concat(every(f"{NAME}{SIGN}?{QUOTED}"), every(f"{NAME}{SIGN}{BARE}"))).otherwise(none),
        F.when(named, F.concat(every(f"^{SIGN}?{QUOTED}"), every(f"^{SIGN}{BARE}"))).otherwise(none),
        F.when(signed, F.concat(every(f"^{QUOTED}"), every(f"^{BARE}"))).otherwise(none),
    )
    short = F.filter(short, lambda v: ~F.exists(core, lambda c: F.contains(c, v)))
    urls = F.when(word.contains("://"), F.array_except(every(URL), core)).otherwise(none)
    return F.concat(core, F.array_distinct(F.concat(urls, short)))


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source") -> DataFrame:
    """(id, path, word_no, nth, value, word, before, after): every candidate with the words around it."""
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(where, F.lit("")).alias("path"), F.col(text).alias("text"))
    some = F.col("text").rlike(CORE) | F.col("text").rlike(NAME) | F.col("text").rlike(URL)
    rows = rows.where(some).select("id", "path", F.split("text", r"\s+").alias("w"))
    numbered = F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    near = lambda s: F.concat_ws(" ", F.get("w", s["i"] - 2), F.get("w", s["i"] - 1))
    hits = F.filter(
        numbered,
        lambda s: ((F.length(s["x"]) >= LEAST) & s["x"].rlike(CORE)) | s["x"].rlike(URL) | s["x"].rlike(NAME)
        | ((F.length(s["x"]) >= SHORT) & near(s).rlike(rf"{NAME}\s*{SIGN}?$")),
    )
    around = F.transform(
        hits,
        lambda s: F.struct(
            s["i"].alias("word_no"),
            s["x"].alias("word"),
            F.concat_ws(" ", F.get("w", s["i"] - 3), F.get("w", s["i"] - 2), F.get("w", s["i"] - 1)).alias("before"),
            F.coalesce(F.get("w", s["i"] + 1), F.lit("")).alias("after"),
        ),
    )
    words = rows.select("id", "path", F.explode(around).alias("h")).select("id", "path", "h.*")
    found = words.select("*", F.posexplode(values(F.col("word"), F.col("before"))).alias("nth", "value"))
    return found.select("id", "path", "word_no", "nth", "value", "word", "before", "after")


def dictionary(docs: DataFrame, text: str = "text", least: int = SEEN) -> DataFrame:
    """(w): the words of 4 to 12 small letters that stand `least` times or more in the whole corpus."""
    word = r"(?<![^\s\"'(])([a-z]{4,12})(?![^\s.,;:!?)\"'])"
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(word), 1)).alias("w"))
    return stored(words.groupBy("w").count().where(F.col("count") >= least).select("w"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(vid, covered): how many letters of each distinct value stand in dictionary words, if any do."""
    runs = found.select("value").distinct().select(
        F.xxhash64("value").alias("vid"), F.posexplode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{4,})"), 1)).alias("r", "run")
    )
    # From every letter on, what up to 12 letters follow; each beginning of it may be a word.
    windows = runs.select("vid", "r", F.posexplode(F.regexp_extract_all("run", F.lit("(?=([a-z]{4,12}))"), 1)).alias("p", "ahead"))
    parts = windows.select("vid", "r", "p", F.explode(F.sequence(F.lit(4), F.length("ahead"))).alias("n"), "ahead")
    parts = parts.select("vid", "r", "p", "n", F.expr("substring(ahead, 1, n)").alias("k"))
    keys = words.select(F.col("w").alias("k"))
    hits = stored(maybe_in(parts, keys)).join(keys.hint("merge"), "k").groupBy("vid", "r", "p").agg(F.max("n").alias("n"))
    spans = hits.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("r", "p", "n"))).alias("at"))
    start = F.struct(F.lit(-1).alias("r"), F.lit(0).alias("end"), F.lit(0).alias("covered"))

    def add(acc, x):
        same = acc["r"] == x["r"]
        end = F.when(same, F.greatest(acc["end"], x["p"] + x["n"])).otherwise(x["p"] + x["n"])
        new = end - F.when(same, F.greatest(acc["end"], x["p"])).otherwise(x["p"])
        return F.struct(x["r"].alias("r"), end.alias("end"), (acc["covered"] + F.greatest(new, F.lit(0))).alias("covered"))

    return spans.select("vid", F.aggregate("at", start, add)["covered"].alias("covered"))


def with_features(found: DataFrame, words: DataFrame | list[str]) -> DataFrame:
    if isinstance(words, list):
        words = found.sparkSession.createDataFrame([(w,) for w in words], "w string")
    found = stored(found)  # so a value that is everywhere can be split in the join
    keyed = found.withColumn("vid", F.xxhash64("value"))
    known = keyed.join(stored(coverage(found, words)).hint("merge"), "vid", "left")
    value, lead = F.col("value"), F.expr("substring_index(word, value, 1)")
    context = F.concat_ws(" ", "before", lead)
    urls = F.regexp_extract_all("word", F.lit(URL), 1)
    letters = F.array_max(F.transform(F.split(value, r"[^A-Za-z]+"), lambda x: F.length(x)))
    n = F.length(value)
    columns = {
        "length": n,
        "digits": share(value, "[0-9]"),
        "uppers": share(value, "[A-Z]"),
        "lowers": share(value, "[a-z]"),
        "symbols": share(value, r"[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "switches": share(value, r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "vowel_pairs": share(F.lower(value), r"(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]|(?<=[bcdfghjklmnpqrstvwxyz])[aeiou]"),
        "longest_letters": letters / n,
        "coverage": F.coalesce("covered", F.lit(0)) / n,
        "credential_before": context.rlike(CREDENTIAL),
        "assigned": lead.rlike(r"[=:]>?\s*[\"'`]?$") | (lead.rlike(r"^[\"'`]?$") & F.col("before").rlike(r"[=:]>?$")),
        "quoted": lead.rlike(r"[\"'`]$"),
        "example_near": F.concat_ws(" ", context, "after").rlike(EXAMPLE),
        "path_parts": F.size(F.split("path", r"[/\\]")),
        "path_example": F.col("path").rlike(EXAMPLE),
        "mail": value.contains("@"),
        "dots": F.regexp_count(value, F.lit(r"\.")),
        "in_url": F.exists(urls, lambda p: F.contains(p, value) | F.endswith(p, F.substring_index(value, "@", 1))),
    }
    return known.select(*found.columns, *(columns[c].cast("double").alias(c) for c in FEATURES))


def weak_labels(found: DataFrame) -> DataFrame:
    """`found` with `label`: 1 for values of an issuer's form, assigned random or quoted ones and URL passwords, 0 for harmless forms, else null."""
    value, own = F.col("value"), F.substring_index("value", "@", 1)
    url = (F.col("in_url") > 0) & ~own.rlike(EXAMPLE) & ~own.rlike(BLANK)
    blank = value.rlike(EXAMPLE) | value.rlike(BLANK) | (F.col("example_near") > 0) & (F.col("digits") == 0)
    literal = (F.col("credential_before") > 0) & (F.col("quoted") > 0)
    harmless = value.rlike(HARMLESS) & ~literal | blank
    random = (F.col("digits") >= 0.1) & (F.col("switches") >= 0.1) & ~value.contains("@")
    secret = value.rlike(ISSUED) | random & (F.col("credential_before") > 0) & (F.col("assigned") > 0)
    secret = secret | url | literal & ~value.rlike(HARMLESS) & ~blank
    return found.withColumn("label", F.when(secret, 1).when(harmless, 0))


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source", labelled: DataFrame | None = None
) -> DataFrame:
    """Every candidate with `score`, the forest's probability that it is a secret, and `is_secret`.

    `labelled` may give findings (value, word, before, after, path, label) in place of the weakly labelled ones.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    words = dictionary(docs, text)
    found = stored(weak_labels(with_features(candidates(docs, text, key, path), words)))
    taught = found if labelled is None else with_features(labelled.drop(*FEATURES), words)
    taught = taught.where("label is not null").select(F.col("label").cast("double").alias("label"), *FEATURES)
    counts = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    given = F.coalesce(F.col("label").cast("double"), F.lit(0.0))
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) == 0:
        scored = found.withColumn("score", given)
    else:
        # Each kind gives at most half of the trained rows, by a hash of the features, so reruns agree.
        at = F.pmod(F.xxhash64(F.lit(SEED), *FEATURES), F.lit(1 << 20))
        part = {y: int(min(1.0, TRAINED / 2 / c) * (1 << 20)) for y, c in counts.items()}
        sample = taught.where(reduce(lambda a, b: a | b, [(F.col("label") == y) & (at < p) for y, p in part.items()]))
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="__x")
        forest = RandomForestClassifier(
            featuresCol="__x", labelCol="label", predictionCol="__y", rawPredictionCol="__raw", probabilityCol="__p",
            numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        ).fit(assemble.transform(sample))
        scored = forest.transform(assemble.transform(found.drop("label"))).withColumn("score", vector_to_array("__p")[1])
    return scored.select(
        "id", "path", "word_no", "nth", "value", *FEATURES, "score", (F.col("score") >= THRESHOLD).alias("is_secret")
    )


def op3(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs).select(
        F.col("id").alias("doc_id"), F.col("word_no").cast("int").alias("word_no"), "nth", "value",
        F.round("score", 6).alias("score"), "is_secret",
    )
