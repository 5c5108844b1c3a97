"""Token counts that follow edits.

Each document's pre-tokens are the leaves' content of a segment tree with characters and tokens summed per subtree. An
edit re-encodes only the leaves that it touches and their neighbours, until a pre-token boundary falls where an old one
was; all sums above are updated on the way to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import PreTokens

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


class CountTree:
    """Tokens of a text under edits. `encoded`: characters encoded so far, the first pass included."""

    def __init__(self, text: str, pre: PreTokens, leaf: int = 32):
        self.pre = pre
        pieces = pre.split(text)
        self.texts = ["".join(pieces[i : i + leaf]) for i in range(0, len(pieces), leaf)] or [""]
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, t in enumerate(self.texts):
            self.chars[self.size + k] = len(t)
            self.tokens[self.size + k] = pre.count(pieces[k * leaf : (k + 1) * leaf])
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.encoded = len(text)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at` (the last one that holds any, for the end), and the characters before it."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = self.size + leaf
        dc, dt = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def _next(self, leaf: int) -> int | None:
        """The next leaf with characters."""
        k = self.size + leaf
        while k > 1:
            if k % 2 == 0 and self.chars[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.chars[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start..end; returns how many characters were encoded again."""
        # a change can reach into the pre-token before it, and a run of white space looks one character ahead
        first, before = self._leaf(max(start - 1, 0))
        if before and start - 1 == before:
            first, before = self._leaf(before - 1)
        last, _ = self._leaf(max(end - 1, start - 1, 0))
        leaves = [first]
        while leaves[-1] < last:
            leaves.append(self._next(leaves[-1]))
        region = "".join(self.texts[k] for k in leaves)
        region = region[: start - before] + new + region[end - before :]
        while True:
            following = self._next(leaves[-1])
            if following is None:
                pieces = self.pre.split(region)
                break
            context = self.texts[following]
            pieces, n = [], 0
            for p in self.pre.split(region + context):
                if n >= len(region):
                    break
                pieces.append(p)
                n += len(p)
            if n == len(region):
                break
            region += context
            leaves.append(following)
        for k in leaves[1:]:
            self._put(k, "", 0)
        self._put(first, region, self.pre.count(pieces))
        self.encoded += len(region)
        return len(region)


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query counts: e-mail addresses become [email], lines equal to an earlier line go with their \\n."""
    import re

    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((max(at - 1, 0), at + len(line), ""))
        else:
            seen.add(line)
            out.extend((at + m.start(), at + m.end(), "[email]") for m in re.finditer(EMAIL, line))
        at += len(line) + 1
    return out


def count_tokens(docs: DataFrame, edits=cleaning_edits, pre: PreTokens | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_again, text_after) per document.

    edits: a function from a text to replacements (start, end, new) in code points, in order and apart from each other.
    A null or empty text has no tokens. Special tokens' strings count as ordinary text. Rows are independent.
    """
    pre = pre or PreTokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                tree = CountTree(text, pre)
                before, again, shift, changes = tree.total, 0, 0, edits(text)
                for a, b, new in changes:
                    again += tree.edit(a + shift, b + shift, new)
                    shift += len(new) - (b - a)
                out.append((before, len(changes), tree.total, again, tree.text()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again", "text_after"])

    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_encoded_again long, text_after string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
