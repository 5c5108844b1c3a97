"""Token ids of the public 50k byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _load(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(json_path), fast


class ByteBpe:
    """The ids that the `tokenizers` file gives (add_special_tokens=False).

    The same vocabulary exists as merge ranks, whose encoder gives the same ids several times faster; it takes ordinary
    texts. A text that holds a special token's string goes through the `tokenizers` file itself. Paths are parameters and
    resolved where the tasks run.
    """

    special = "<|endoftext|>"

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        self.json_path, self.ranks_path = json_path, ranks_path

    def _pair(self):
        return _load(self.json_path or tokenizer_path("byte_bpe_50k.json"), self.ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"))

    def encode(self, text: str) -> np.ndarray:
        exact, fast = self._pair()
        if self.special in text:
            return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def count_piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self._pair()[1].encode_ordinary(piece))


class PreTokens:
    """Pre-tokens of the byte-level BPE, and their token counts, remembered for the frequent ones."""

    #: Counts that a task remembers; the memory is emptied when full.
    remembered = 300_000

    def __init__(self, bpe: ByteBpe | None = None):
        self.bpe = bpe or ByteBpe()
        self._counts: dict[str, int] = {}
        self._pattern = None

    def __getstate__(self):
        return {"bpe": self.bpe, "_counts": {}, "_pattern": None}

    def split(self, text: str) -> list[str]:
        if self._pattern is None:
            import public_tokenizers
            import regex

            self._pattern = regex.compile(public_tokenizers.PATTERN)
        return self._pattern.findall(text)

    def count(self, pieces: list[str]) -> int:
        known = self._counts
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            if len(known) > self.remembered:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = self.bpe.count_piece(p)
            return sum([known[p] for p in pieces])
