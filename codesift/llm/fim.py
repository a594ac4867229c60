"""Fill-in-middle transformation: token boundaries as a Roaring-style set, cut offsets by select.

A text's units are its tokens: white space with the word behind it, or white space at the end of the text. The offsets
(in code points) at which units end form a boundary set. It is split by the offsets' upper bits into containers of
2^16 offsets; each container is an array, a bitmap or a list of runs, whichever is smallest, and cumulative
cardinalities say how many boundaries come before each. `select(i)`, the offset of the i-th boundary, is a search among
these counts and a select inside one container, so both cuts of a text come without another pass over it.

The cuts come from a hash of seed and key: reruns, retries and other partitions give the same rows. The rest (form,
output, its inverse) is built of Spark's own string functions. The transformation is narrow: nothing is shuffled, no
document meets another, and a long text is read in blocks of bounded size.

Defined cases: null counts as an empty text, and an empty text is plain; a text that holds a sentinel is plain, so every
output can be taken apart again; a null key hashes as an empty string; rows with the same key are cut by the same
numbers, each within its own text; an empty table gives an empty result; other columns pass through, and the added
column takes a free name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codesift.llm.common import SPACES, apart, free_name

SEED = 42
#: Of a hundred: texts that stay plain, and of the others those with the suffix first.
PLAIN, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text that are looked at in one go.
BLOCK = 1 << 20
#: Container bounds: offsets of a container, and the largest cardinality that an array holds in less than a bitmap.
SPAN, ARRAY = 1 << 16, 4096


class Array:
    """A few offsets, in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])

    def __len__(self) -> int:
        return len(self.low)


class Bitmap:
    """A bit for each offset of the container, and the number of bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little")
        in_word = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(in_word)))

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.bytes[word * 8 : word * 8 + 8], bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[i - self.before[word]])

    def __len__(self) -> int:
        return int(self.before[-1])


class Runs:
    """First offsets of runs of neighbouring offsets, and the number of offsets before each run."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first = first.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(length)))

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.first[run]) + i - int(self.before[run])

    def __len__(self) -> int:
        return int(self.before[-1])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container for sorted offsets below SPAN."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(low), SPAN // 8):
        return Runs(low[starts], np.diff(starts, append=len(low)))
    return Array(low) if len(low) <= ARRAY else Bitmap(low)


class Boundaries:
    """A sorted set of offsets in containers, with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        upper = offsets >> 16
        first = np.flatnonzero(np.diff(upper, prepend=-1))
        self.upper = upper[first]
        self.before = np.append(first, len(offsets))
        self.containers = [container(part & (SPAN - 1)) for part in np.split(offsets, first[1:])] if len(offsets) else []

    def select(self, i: int) -> int:
        """The i-th offset, from 0."""
        at = int(np.searchsorted(self.before, i, side="right")) - 1
        return (int(self.upper[at]) << 16) + self.containers[at].select(i - int(self.before[at]))

    def __len__(self) -> int:
        return int(self.before[-1])


def boundaries(text: bytes) -> np.ndarray:
    """The code point offsets at which the units of a UTF-8 text end."""
    ends, points, in_word = [], 0, False
    for at in range(0, len(text), BLOCK):
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        word = ~SPACES[data]
        starts = (data & 0xC0) != 0x80  # of characters
        offset = np.cumsum(starts) - starts + points  # of the character that a byte belongs to, at its first byte
        ends.append(offset[np.concatenate(([in_word], word[:-1])) & ~word])
        points, in_word = points + int(np.count_nonzero(starts)), bool(word[-1])
    return np.array([*np.concatenate(ends), points], np.int64) if ends else np.empty(0, np.int64)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    found = []
    for raw, a, b in zip(text.cast(pa.binary()), one.to_pylist(), two.to_pylist()):
        units = Boundaries(boundaries(raw.as_py()))
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        found.append((len(units), units.select(low - 1) if low else 0, units.select(high - 1) if high else 0))
    columns = np.array(found, np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "first", "second"])


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of `transform` was made of. Sentinels do not overlap, so they part it without doubt."""
    part = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


@apart
def transform(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = SEED,
    plain: int = PLAIN,
    spm: int = SPM,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    name: str = "fim",
) -> DataFrame:
    """`docs` with a last column, a struct of n (units), form, prefix_chars, middle_chars and output.

    `plain` of a hundred texts stay as they are, `spm` of a hundred others have the suffix first. The column is called
    `name`, or by a free name that begins with it. Each sentinel begins with a character that it holds nowhere else.
    """
    p, s, m = sentinels
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    cut_column = free_name(docs.columns, "cuts")
    cut = docs.withColumn(cut_column, _cuts(body, numbers[0], numbers[1]))
    holds = F.contains(body, F.lit(p)) | F.contains(body, F.lit(s)) | F.contains(body, F.lit(m))
    form = (
        F.when((body == "") | holds | (numbers[2] % 100 >= plain), "plain").when(numbers[3] % 100 < spm, "spm").otherwise("psm")
    )
    first, second = (F.col(f"{cut_column}.{c}").cast("int") for c in ("first", "second"))
    prefix, middle = F.substring(body, F.lit(1), first), F.substring(body, first + 1, second - first)
    suffix = F.substring(body, second + 1, F.char_length(body))
    output = (
        F.when(form == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(form == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(body)
    )
    split = form != "plain"
    made = F.struct(
        F.col(f"{cut_column}.n").alias("n"),
        form.alias("form"),
        F.when(split, first.cast("long")).alias("prefix_chars"),
        F.when(split, (second - first).cast("long")).alias("middle_chars"),
        output.alias("output"),
    )
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns), made.alias(free_name(docs.columns, name)))


def op11(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
numbered AS (
  SELECT doc_id, t, units, len(units) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
