"""Production parameters of the bound queries and of the pipeline."""

from __future__ import annotations

import public_tokenizers

from scholium.llm.bpe import read_definition
from scholium.llm.byte_bpe import read_ranks

VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS, BYTE_PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN

# Shares of the mix: the largest source is held back, two are doubled, all others share the rest.
MIX = {"src0": 4.0, "src1": 8.0, "src2": 8.0, "src3": 2.0}
MIX_OTHERS = 60.0

# Folds of labels (crc32 of the id) and the one that is never learned from; scores from which a label is predicted.
TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_THRESHOLD = 3, 1, 0.7
QUALITY_FOLDS, QUALITY_HELD_OUT, QUALITY_THRESHOLD = 5, 0, 0.3
PPM_FOLDS, PPM_HELD_OUT = 10, 0

# Ids whose CRC-32 this divides are tampered with after the manifest was made.
TAMPERED_EVERY = 5


def vocabulary() -> str:
    return read_definition(public_tokenizers.path(VOCABULARY))


def byte_ranks() -> bytes:
    return read_ranks(public_tokenizers.path(BYTE_RANKS))
