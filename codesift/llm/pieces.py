"""Reading a SentencePiece model file: pieces, scores, kinds and normaliser settings.

The file's path is a parameter. The driver reads it once; its bytes (bounded by `MOST_BYTES`) go to the tasks.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

MOST_BYTES = 32_000_000
DEFAULT_MODEL = os.environ.get("CODESIFT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Kinds of pieces and models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def model_bytes(path: str = DEFAULT_MODEL) -> bytes:
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


@dataclass
class Pieces:
    """Normal pieces by text, and what a text goes through before and after them."""

    kind: int
    names: list[str]
    kinds: list[int]
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unk: int
    prefix: bool
    squeeze: bool
    longest: int
    bytes_of: dict[int, int] = field(default_factory=dict)

    def normalise(self, text: str) -> str:
        """Spaces become the space mark; one mark comes before the text. The identity normaliser changes nothing else."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)


@lru_cache(maxsize=4)
def parse(blob: bytes) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(blob)
    norm, trained = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser and leading space marks are supported")
    names = [p.piece for p in model.pieces]
    kinds = [p.type for p in model.pieces]
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
    by_byte = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE}
    return Pieces(
        kind=trained.model_type,
        names=names,
        kinds=kinds,
        ids=ids,
        scores={p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)},
        byte_ids=[by_byte[b] for b in range(256)] if trained.byte_fallback else None,
        unk=trained.unk_id,
        prefix=norm.add_dummy_prefix,
        squeeze=norm.remove_extra_whitespaces,
        longest=max(map(len, ids)),
        bytes_of={i: b for b, i in by_byte.items()},
    )


def chunk_pattern(pieces: Pieces) -> str:
    """Chunks that no piece crosses: marks, then what follows up to the next mark."""
    if any(SPACE in name.lstrip(SPACE) for name in pieces.ids):
        return r"[\s\S]+"
    return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
