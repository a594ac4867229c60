"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every piece that ends at each place of a chunk of text; dynamic programming carries the
best score and the number of pieces of the best path, and no path is kept. Ties go by the tokenizer's rule: paths are
tried in the order of their last piece's start, and a later one must be strictly better. A character that no piece
covers costs the smallest score less 10 and counts one piece, or one a byte with byte fallback; runs of such characters
without byte fallback count one.

The scores are those of the model file, read as a unigram vocabulary. Scores are summed in double precision and
chunks are solved apart, as no piece crosses from a chunk to the next.

Defined cases: null and empty texts count 0; a literal space mark is a space, as for the tokenizer; repeated rows are
counted alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.common import apart
from codesift.llm.pieces import DEFAULT_MODEL, chunk_pattern, model_bytes, parse

#: Counts of chunks that a task remembers, of chunks no longer than LONG.
REMEMBERED, LONG = 300_000, 64
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, blob: bytes):
        import ahocorasick

        self.pieces = parse(blob)
        self.machine = ahocorasick.Automaton()
        for name, score in self.pieces.scores.items():
            self.machine.add_word(name, (len(name), score))
        self.machine.make_automaton()
        self.unknown = min(self.pieces.scores.values()) - UNKNOWN_PENALTY
        self.chunks = re.compile(chunk_pattern(self.pieces))
        # Two generations: when the newer is full it becomes the older, and what is used again moves up.
        self.known: dict[str, tuple[int, bool, bool]] = {}
        self.older: dict[str, tuple[int, bool, bool]] = {}

    def chunk(self, text: str) -> tuple[int, bool, bool]:
        """Pieces of the best path, and whether the path starts and ends with an unknown character."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.machine.iter(text):
            ends[end].append(match)
        # For each place: score and count of the best path, whether its last and its first character are unknown.
        best = [(0.0, 0, False, False)] * (n + 1)
        fallback = self.pieces.byte_ids is not None
        for end in range(n):
            value = None
            single = False
            for length, score in ends[end]:  # longest first, so starts ascend
                s, c, _, lead = best[end + 1 - length]
                single = single or length == 1
                if value is None or s + score > value[0]:
                    value = (s + score, c + 1, False, lead)
            if not single:
                s, c, last, lead = best[end]
                if value is None or s + self.unknown > value[0]:
                    if fallback:
                        c += len(text[end].encode("utf-8", "surrogatepass"))
                    elif not last:
                        c += 1
                    value = (s + self.unknown, c, True, lead or end == 0)
            best[end + 1] = value
        _, count, last, lead = best[n]
        return count, lead, last

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, older, total, open_run, merge = self.known, self.older, 0, False, self.pieces.byte_ids is None
        for chunk in self.chunks.findall(self.pieces.normalise(text)):
            found = known.get(chunk)
            if found is None:
                found = older.get(chunk) or self.chunk(chunk)
                if len(chunk) <= LONG:
                    if len(known) >= REMEMBERED:
                        self.older, self.known = older, known = known, {}
                    known[chunk] = found
            total += found[0]
            if merge:  # a run of unknown characters goes on from chunk to chunk
                total -= open_run and found[1]
                open_run = found[2]
        return total


@apart
def count_tokens(docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """`docs` with `__tokens`, the number of pieces of the text."""
    handed = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches):
        counter = Counter(handed.value)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            counts = [counter.count(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], *batch.columns[at + 1 :], pa.array(np.array(counts, dtype=np.int64))]
            names = [*batch.schema.names[:at], *batch.schema.names[at + 1 :], "__tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("__tokens", LongType())])
    return docs.withColumn("__text", F.col(text)).mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.col("__tokens").alias("n_tokens"))
