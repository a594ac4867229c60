"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (spaces to the space mark, one mark before the text),
the pieces (an arc for each piece of the text it spells) and byte fallback (arcs from a character that no piece spells
to its bytes). Their composition with an input is an acyclic lattice over the input's places, and the encoding is its
shortest path in the tropical semiring.

Weights: in a unigram model a piece weighs its negated score. In a BPE model the order of merges decides, which is a
condition on neighbours: a sequence of pieces is the merges' result exactly if every two neighbours are the merges'
result for their joint text. So an arc between neighbours that fail the condition weighs infinity, and others 0. As
each prefix of a text has one result of merges, one path of finite weight leads to each place, and its last piece is
all that the next arcs need to know. A character of byte fallback never merges, so nothing is asked of its neighbours.

The lattice is solved for a chunk of text that no piece crosses, and a task remembers chunks it has solved.

Defined cases: null and empty texts have no pieces, and decode to null and the empty text; a literal space mark is a
space, as for the tokenizer, and decodes to one; repeated rows are encoded alike; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from codesift.llm.common import apart
from codesift.llm.pieces import BPE, BYTE, CONTROL, DEFAULT_MODEL, SPACE, UNKNOWN, chunk_pattern, model_bytes, parse

#: Chunks and neighbour conditions that a task remembers, and the longest chunk remembered.
REMEMBERED, LONG = 300_000, 64
UNKNOWN_PENALTY = 10.0
#: The state after a character of byte fallback, and the start.
FREE = -1


class Transducer:
    def __init__(self, blob: bytes):
        self.pieces = p = parse(blob)
        self.bpe = p.kind == BPE
        self.ids, self.names = p.ids, p.names
        self.weight = {p.ids[name]: 0.0 if self.bpe else -score for name, score in p.scores.items()}
        self.unknown_weight = max(self.weight.values(), default=0.0) + UNKNOWN_PENALTY
        self.chunks = re.compile(chunk_pattern(p))
        # Two generations: when the newer is full it becomes the older, and what is used again moves up.
        self.solved: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.allowed: dict[int, bool] = {}
        # The piece transducer's arcs into each place of a text, longest first.
        import ahocorasick

        self.arcs = ahocorasick.Automaton()
        for name, i in p.ids.items():
            self.arcs.add_word(name, (i, len(name)))
        self.arcs.make_automaton()
        self.spelled = [self._spelled(i) for i in range(len(p.names))]

    def _spelled(self, i: int) -> bytes:
        kind = self.pieces.kinds[i]
        if kind == BYTE:
            return bytes([self.pieces.bytes_of[i]])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.names[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def merges(self, text: str) -> list[str]:
        """The result of merging two neighbours at a time, best score first and then leftmost."""
        part, scores = list(text), self.pieces.scores
        while True:
            best, at = None, -1
            for i in range(len(part) - 1):
                score = scores.get(part[i] + part[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]

    def allow(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`: the merges' result for their joint text is the two."""
        names = [self.names[right]] if left == FREE else [self.names[left], self.names[right]]
        ok = self.merges("".join(names)) == names
        if len(self.allowed) >= 4 * REMEMBERED:
            self.allowed.clear()
        self.allowed[(left + 1) * len(self.names) + right] = ok
        return ok

    def merged(self, text: str) -> tuple[list[int], list[int]]:
        """BPE: for each place, the last piece of the one path of finite weight into it, and where that piece starts."""
        allowed, size, n = self.allowed, len(self.names), len(text)
        # A character that no piece spells leaves its place as it is here: free, one character long.
        piece, start = [FREE] * (n + 1), list(range(-1, n))
        for last, (arc, length) in self.arcs.iter(text):
            if piece[last + 1] == FREE:
                at = last + 1 - length
                ok = allowed.get((piece[at] + 1) * size + arc)
                if ok or ok is None and self.allow(piece[at], arc):
                    piece[last + 1], start[last + 1] = arc, at
        return piece, start

    def cheapest(self, text: str) -> tuple[list[int], list[int]]:
        """Unigram: the same for the path of least weight; a tie keeps the longer last piece."""
        n = len(text)
        into: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, arc in self.arcs.iter(text):
            into[last].append(arc)
        weight, piece, start = [0.0] * (n + 1), [FREE] * (n + 1), list(range(-1, n))
        for end in range(1, n + 1):
            best = float("inf")
            for arc, length in into[end - 1]:
                other = weight[end - length] + self.weight[arc]
                if other < best:
                    best, piece[end], start[end] = other, arc, end - length
            if text[end - 1] not in self.ids and weight[end - 1] + self.unknown_weight < best:
                best, piece[end], start[end] = weight[end - 1] + self.unknown_weight, FREE, end - 1
            weight[end] = best
        return piece, start

    def solve(self, text: str) -> tuple[int, ...]:
        """The shortest path of a chunk's lattice, as piece ids."""
        n = len(text)
        piece, start = self.merged(text) if self.bpe else self.cheapest(text)
        out: list[int] = []
        end = n
        while end:
            if piece[end] != FREE:
                out.append(piece[end])
            elif self.pieces.byte_ids is not None:
                out.extend(self.pieces.byte_ids[b] for b in reversed(text[start[end]].encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.pieces.unk:
                out.append(self.pieces.unk)
            end = start[end]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        solved, older = self.solved, self.older
        unk = self.pieces.unk if self.pieces.byte_ids is None else None
        for chunk in self.chunks.findall(self.pieces.normalise(text)):
            ids = solved.get(chunk)
            if ids is None:
                ids = older.get(chunk) or self.solve(chunk)
                if len(chunk) <= LONG:
                    if len(solved) >= REMEMBERED:
                        self.older, self.solved = older, solved = solved, {}
                    solved[chunk] = ids
            if unk is not None and out and out[-1] == unk and ids and ids[0] == unk:
                ids = ids[1:]
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The transducer read backwards: bytes join to characters, space marks become spaces, the first one goes."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def _with_text(docs: DataFrame, column: str, run, added: list[StructField]) -> DataFrame:
    schema = StructType([*docs.schema.fields, *added])
    return docs.withColumn("__in", F.col(column)).mapInArrow(run, schema)


@apart
def encode(docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, decoded: bool = False) -> DataFrame:
    """`docs` with `__ids`, the piece ids of the text, and on request `__decoded`, the text read back from them."""
    handed = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches):
        machine = Transducer(handed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # bounded ids and decoded texts in memory
                part = batch.slice(at, 64)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [machine.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = array("i")
                for ids in found:
                    flat.extend(ids)
                values = pa.array(np.frombuffer(flat, dtype=np.int32))
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), values)]
                names = [*part.schema.names[:-1], "__ids"]
                if decoded:
                    back = [None if t is None else machine.decode(ids) for t, ids in zip(texts, found)]
                    columns.append(pa.array(back, pa.string()))
                    names.append("__decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    added = [StructField("__ids", ArrayType(IntegerType()))]
    return _with_text(docs, text, run, [*added, StructField("__decoded", StringType())] if decoded else added)


@apart
def decode(docs: DataFrame, ids: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """`docs` with `__decoded`, the text of the piece ids in column `ids`; null for null."""
    handed = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches):
        machine = Transducer(handed.value)
        for batch in batches:
            found = [None if i is None else machine.decode(i) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*batch.schema.names[:-1], "__decoded"])

    return _with_text(docs, ids, run, [StructField("__decoded", StringType())])


def op5(spark, sf_dir: str) -> DataFrame:
    from codesift.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("__ids").cast(LongType()).alias("n_tokens"),
        F.col("__ids").alias("ids"),
        F.col("__decoded").alias("decoded"),
        F.col("__decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
