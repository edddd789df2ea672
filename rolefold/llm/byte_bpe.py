"""Ids of a byte-level BPE tokenizer file, computed by the faster of two public libraries.

``tiktoken`` merges by rank what ``tokenizers`` merges by its list; where a file's ids are its ranks both give the same ids (checked over every code point),
and ``tokenizers`` takes the texts whose runs of blanks are too long for the other's pattern.
"""

from __future__ import annotations

import json

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pattern of a byte-level pre-tokenizer that uses its own one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte of each printable character that stands for one."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(others)): b for b in range(256)}


def token_bytes(spec: str) -> dict[int, bytes]:
    """Bytes of every entry of the vocabulary, special tokens by their text."""
    data, letters = json.loads(spec), byte_letters()
    entries = {i: bytes(letters[c] for c in token) for token, i in data["model"]["vocab"].items()}
    return entries | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


class ByteBpe:
    """``special`` tells whether special tokens in a text become their ids; otherwise they are plain text."""

    def __init__(self, spec: str, special: bool):
        data, letters = json.loads(spec), byte_letters()
        vocab = data["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in data["model"]["merges"]]
        ranked = all(vocab["".join(m)] == len(letters) + k for k, m in enumerate(merges))
        pre = data["pre_tokenizer"]
        if not ranked or data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE whose ids are ranks is expected")
        self.spec, self.special, self.whole = spec, special, None
        self.fast = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in token): i for token, i in vocab.items()},
            special_tokens={t["content"]: t["id"] for t in data["added_tokens"]})

    def encode(self, text: str) -> list[int]:
        try:
            if self.special:
                return self.fast.encode(text, allowed_special="all", disallowed_special=())
            return self.fast.encode_ordinary(text)
        except ValueError:
            if self.whole is None:
                self.whole = Tokenizer.from_str(self.spec)
                self.whole.no_truncation()
                self.whole.no_padding()
                self.whole.encode_special_tokens = not self.special
            return self.whole.encode(text, add_special_tokens=False).ids
