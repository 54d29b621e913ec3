"""A byte-level BPE vocabulary as the tokenizers library writes it, read into a form that tasks
can hold: ranked byte strings for the merge engine and the bytes of every id.

The engine gives the ids that the tokenizers library gives for the same file; ``load`` refuses
a file whose settings it does not cover.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import regex
import tiktoken

# The split of byte-level BPE: contractions, letters, digits, other marks, white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A match of the split depends on no more than this many characters behind its end.
LOOK_AHEAD = 3


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Codec:
    ranks: dict[bytes, int]
    special: dict[str, int] = field(default_factory=dict)

    @cached_property
    def engine(self) -> tiktoken.Encoding:
        return tiktoken.Encoding(
            "byte_bpe", pat_str=PRETOKEN, mergeable_ranks=self.ranks, special_tokens=self.special
        )

    @cached_property
    def pretoken(self) -> regex.Pattern:
        return regex.compile(PRETOKEN)

    @cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id."""
        size = max([*self.ranks.values(), *self.special.values()]) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        for token, rank in self.special.items():
            lengths[rank] = len(token.encode())
        return lengths

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens in it become those tokens."""
        return self.engine.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of bytes that the split leaves whole."""
        return self.engine._encode_single_piece(piece) if piece else []

    def decode(self, ids) -> str:
        return self.engine.decode_bytes(ids).decode("utf-8", "replace")


def load(path: str) -> Codec:
    """Read a tokenizers file of kind byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, split = made["model"], made["pre_tokenizer"]
    plain = (
        model["type"] == "BPE"
        and made["normalizer"] is None
        and split["type"] == "ByteLevel"
        and split.get("use_regex", True)
        and not split["add_prefix_space"]
        and not model.get("byte_fallback")
        and not model.get("ignore_merges")
        and model.get("dropout") is None
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
    )
    added = made["added_tokens"]
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    if not plain:
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    byte_of = _byte_of_char()
    special = {t["content"]: t["id"] for t in added}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in model["vocab"].items()
        if token not in special
    }
    order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if order != sorted(order):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    return Codec(ranks, special)
