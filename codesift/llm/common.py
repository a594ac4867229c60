"""Helpers shared by the operators: tables, the shared folder, word hashes."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where the session names none (tests on one machine), a folder of our own is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark, "_codesift_shared", None) or tempfile.mkdtemp(prefix="codesift-shared-")
        spark._codesift_shared = d
    return d.rstrip("/")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write `df` as Parquet to the shared folder and read it back.

    A lost executor costs one re-read. The files stay until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """`name`, or `name` with the first number that makes it differ from all `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def apart(operator):
    """For operators on `docs` that pass its columns through: columns named like the operators' own stand aside meanwhile.

    All names of the operators' own begin with `__`. Columns of `docs` that do so as well, and names with dots or back
    quotes (which `mapInArrow` cannot pass), are others while the operator runs, and themselves again in its result;
    arguments that name them follow. A column that the operator adds takes a free name if `docs` has one of its name.
    Without such columns nothing changes, the plan neither.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__") or "." in c or "`" in c:
                aside[c] = free_name([*docs.columns, *aside.values()], f"aside{len(aside)}")
        if not aside:
            return operator(docs, *args, **options)
        follow = lambda x: aside.get(x, x) if isinstance(x, str) else x
        moved = docs.select(*(quoted(c).alias(aside.get(c, c)) for c in docs.columns))
        out = operator(moved, *map(follow, args), **{k: follow(x) for k, x in options.items()})
        own, taken, columns = {v: k for k, v in aside.items()}, list(docs.columns), []
        for c in out.columns:
            if c not in moved.columns:
                taken.append(free_name(taken, c))
                columns.append(quoted(c).alias(taken[-1]))
            else:
                columns.append(quoted(c).alias(own.get(c, c)))
        return out.select(*columns)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `rows` whose `k` may be in `keys`: all that are, and few others while the bitmap is not full.

    The bitmap has 2^23 bits, one hash a key, in at most 131,072 rows of 64 bits; that bounds its broadcast.
    """
    place = F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1 << 23))
    bit = F.expr("shiftleft(1L, CAST(__at & 63 AS INT))")
    bits = keys.select(place.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.withColumn("__at", place).withColumn("__w", F.shiftright("__at", 6)).join(F.broadcast(bits), "__w")
    return marked.where(F.col("__bits").bitwiseAND(bit) != 0).select(*rows.columns)


def words(text):
    """Column: the words of a text; null and empty give an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


# --- Word hashes of a batch of texts, by numpy over its bytes ---------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for a process up to 8 M."""
    kept = _kept_powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 21), base, dtype=np.uint64)
        kept[0] = 1
        with np.errstate(over="ignore"):
            kept = np.multiply.accumulate(kept)
        if len(kept) <= 1 << 23:
            _kept_powers[int(base)] = kept
    return kept[:n]


#: Separator bytes: white space of the contracts; or everything but ASCII letters, digits and UTF-8 bytes over 0x7F.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_spans(texts: list[str | None], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all `texts`, one line feed after each, and where their words start and end."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], separators[data])).view(np.int8)))
    return data, edge[0::2], edge[1::2]


def word_hashes(texts: list[str | None], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all `texts` (A-Z lower-cased), and the offsets of each text's words.

    The hash of a word is a polynomial over random byte codes modulo 2^64, taken as a difference of prefix sums,
    then mixed with the word's length. Equal words give equal hashes in every process. Null counts as empty.
    """
    data, first, last = word_spans(texts, separators)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(np.fromiter((0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts)) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:])
        out = (sums[last] - sums[first]) * _powers(_BASE_INV, len(data))[first]
        out = mix64(out + (last - first).astype(np.uint64) * _MULT)
    return out, np.concatenate(([0], np.searchsorted(first, ends)))


def slices(texts: list[str | None], most_bytes: int = 1_000_000):
    """Index ranges of `texts` of a bounded size each (a longer text stands alone)."""
    return ranges([0 if t is None else len(t) for t in texts], most_bytes)


def ranges(sizes: list[int | None], most: int = 1_000_000):
    """Index ranges whose `sizes` (null: 0) add up to at most `most` each (a larger one stands alone)."""
    start = size = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
