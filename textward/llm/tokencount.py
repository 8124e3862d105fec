"""Edit-aware token counts.

A document's text is cut to pre-tokens, which the tokenizer encodes each on its
own.  Runs of pre-tokens are the leaves of a segment tree of (characters,
tokens) sums.  An edit re-encodes only the leaves that it touches, one leaf
before, and as many after as it takes until the new cut meets the old one;
then the sums above them change.
"""

from __future__ import annotations

from collections.abc import Iterator


import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import missing_columns

#: pre-tokens per leaf
LEAF = 64
#: a run longer than this is a token counter's worst case, since merging is quadratic; texts with one are still counted whole
_MOST_CACHED = 400_000


class Counter:
    """Tokens of pre-tokens, by a file of ranks in base 64; each distinct pre-token is encoded once."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
        self.known: dict[str, int] = {}

    def cut(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        return self.split.findall(text, start, len(text) if end is None else end)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        new = set(pieces).difference(known)
        if len(known) + len(new) > _MOST_CACHED:
            known.clear()
            new = set(pieces)
        single = self.encoding._encode_single_piece  # each piece on its own: the cut is already made
        for p in new:
            known[p] = len(single(p))
        return list(map(known.__getitem__, pieces))


def _ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tree:
    """Segment tree over leaves: `chars` and `tokens` are heaps whose node i sums nodes 2i and 2i + 1; leaves start at `size`."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = len(chars)
        self.size = 1
        while self.size < self.n:
            self.size *= 2
        self.chars, self.tokens = (self._built(x) for x in (chars, tokens))

    def _built(self, leaves: list[int]) -> list[int]:
        heap = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            heap[i] = heap[2 * i] + heap[2 * i + 1]
        return heap

    @classmethod
    def stored(cls, chars: list[int], tokens: list[int]) -> Tree:
        return cls(list(chars), list(tokens))

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size:self.size + self.n], self.tokens[self.size:self.size + self.n]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end of the text) and where it starts."""
        i, start = 1, 0
        while i < self.size:
            left = 2 * i
            if at < start + self.chars[left] or self.chars[left + 1] == 0:
                i = left
            else:
                start += self.chars[left]
                i = left + 1
        return i - self.size, start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves first..last (exclusive) become the given ones; only sums above changed leaves are computed anew where their number stays."""
        if len(chars) == last - first:
            for k in range(len(chars)):
                i = self.size + first + k
                self.chars[i], self.tokens[i] = chars[k], tokens[k]
            low, high = (self.size + first) // 2, (self.size + last - 1) // 2
            while low >= 1:
                for i in range(low, high + 1):
                    self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                    self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
                low, high = low // 2, high // 2
        else:
            c, t = self.leaves()
            self.__init__(c[:first] + chars + c[last:], t[:first] + tokens + t[last:])


def grouped(pieces: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    chars, tokens = [], []
    for i in range(0, len(pieces), LEAF):
        chars.append(sum(map(len, pieces[i:i + LEAF])))
        tokens.append(sum(counts[i:i + LEAF]))
    return chars, tokens


def build(text: str | None, counter: Counter) -> Tree:
    pieces = counter.cut(text or "")
    return Tree(*grouped(pieces, counter.counts(pieces)))


def edit(tree: Tree, text: str, start: int, removed: int, inserted: str, counter: Counter, ahead: int = 1) -> tuple[str, int]:
    """Apply one edit to the tree.  Returns the new text and how many of its characters were encoded again.

    Pre-tokens depend on what follows them by one run of white space at most, so
    a cut that starts a leaf before the edit is right from there on; after the
    edit the region grows, doubling, until the new cut has a boundary where an
    old leaf ends, at least one pre-token away from the edit.
    """
    start = min(max(start, 0), len(text))
    removed = min(max(removed, 0), len(text) - start)
    new = text[:start] + inserted + text[start + removed:]
    if not tree.n:
        again = build(new, counter)
        tree.__init__(*again.leaves())
        return new, len(new)
    touched, _ = tree.find(start)
    first = max(0, touched - 1)
    while first and _joins(text, sum_before(tree, first)):
        first -= 1  # a leaf that ends in white space may give it to what follows
    from_ = sum_before(tree, first)
    shift = len(inserted) - removed
    last, _ = tree.find(start + removed)
    last = min(tree.n, last + 1)
    chars = tree.leaves()[0]
    while True:
        last = min(tree.n, last + ahead)
        old_end = sum_before(tree, last)
        pieces, at = [], from_
        # one look past the region decides how its last run of white space is cut
        limit = len(new) if last == tree.n else min(len(new), old_end + shift + max(chars[last:last + 2] or [0]))
        ends = []
        for m in counter.split.finditer(new, from_, limit):
            if m.start() >= old_end + shift:
                break
            pieces.append(m.group())
            at = m.end()
            ends.append(at)
        if last == tree.n or at == old_end + shift and limit > at and not new[at - 1].isspace():
            break
        ahead *= 2
    tree.replace(first, last, *grouped(pieces, counter.counts(pieces)))
    return new, at - from_


def _joins(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isspace()


def sum_before(tree: Tree, leaf: int) -> int:
    """Characters of the leaves before `leaf`."""
    i, total = leaf + tree.size, 0
    if leaf >= tree.size:
        return tree.chars[1]
    while i > 1:
        if i & 1:
            total += tree.chars[i - 1]
        i //= 2
    return total


STATE = "struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: long, removed: long, inserted: string>>"


def trees(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> Column:
    """A column with the leaves of each document's tree.  NULL text has none."""
    return _counted(docs, ranks, pattern, text, None, None)["tree"]


def edits_counted(docs: DataFrame, ranks: str, pattern: str, edits: str, text: str = "text", tree: str | None = None) -> Column:
    """A struct column: n_tokens, n_tokens_edited, edited text, chars_encoded by the edits, tree after them.

    `edits` is a column of type EDITS, applied in order, each to the text that the one before
    left; NULL counts as none.  Starts and lengths beyond the text are cut to
    it.  With `tree`, a column that an earlier run made from the same text, nothing but the
    edits is encoded.
    """
    missing_columns(docs, text, edits, *([tree] if tree else []))
    return _counted(docs, ranks, pattern, text, edits, tree)


RESULT = f"struct<n_tokens: long, n_tokens_edited: long, edited: string, chars_encoded: long, tree: {STATE}>"


def _counted(docs: DataFrame, ranks: str, pattern: str, text: str, edits: str | None, tree: str | None) -> Column:
    missing_columns(docs, text)
    kind = pa.struct([("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("edited", pa.string()), ("chars_encoded", pa.int64()),
                      ("tree", pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))])

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter(ranks, pattern)
        for texts, changes, states in batches:
            out = []
            for body, todo, state in zip(texts, changes, states, strict=True):
                body = body.as_py() or ""
                state = state.as_py()
                own = Tree.stored(state["chars"], state["tokens"]) if state else build(body, counter)
                before, encoded = own.total if own.n else 0, 0
                for e in todo.as_py() or ():
                    body, n = edit(own, body, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", counter)
                    encoded += n
                chars, tokens = own.leaves()
                out.append((before, own.total if own.n else 0, body, encoded, {"chars": chars, "tokens": tokens}))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return run(F.col(text), F.col(edits) if edits else F.lit(None).cast(EDITS), F.col(tree) if tree else F.lit(None).cast(STATE))
