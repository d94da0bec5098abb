"""Exact ids of public byte-level BPE tokenizers by the fastest exact way at hand."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

#: The pattern that byte-level tokenizers of this kind split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 20_000  # longer runs without a break go to the tokenizers library, whose time grows more slowly with them


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids, as little-endian 32-bit bytes, equal to those of the tokenizers library with this file.

    Where the file describes plain byte-level BPE whose ids follow its merges, the ids come from tiktoken, which
    then gives the same ids several times faster; any other file is left to the library itself.
    """

    def __init__(self, path: str, ordinary: bool = False):
        """ordinary: the strings of special tokens in a text are ordinary text."""
        self.path, self.ordinary = path, ordinary
        self.allowed = set() if ordinary else "all"
        self.fast = self._fast(path)

    @cached_property
    def tok(self):
        """The library's tokenizer, loaded where a text needs it: workers hold one vocabulary, not two."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = self.ordinary
        return tok

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        vocab, special = model.get("vocab", {}), {t["content"]: t["id"] for t in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        ranks = [vocab.get(a + b, -1) for a, b in pairs]
        simple = (
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(a < b for a, b in zip(ranks, ranks[1:])) and (not ranks or ranks[0] >= 0)
        )
        if not simple:
            return None
        letters = byte_letters()
        table = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        if self.fast is not None and (len(text) < LONG_RUN or max(map(len, text.split())) < LONG_RUN and not text.isspace() and " " * LONG_RUN not in text and "\n" * LONG_RUN not in text):
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
