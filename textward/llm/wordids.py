"""Token ids of whole texts, with each distinct word encoded once per worker.

The tokenizer lower-cases, drops white space and never joins what white space
separates, so a text's ids are the ids of its blank-separated pieces in order.
Unseen pieces are encoded many at a time by the same merges in byte form: the
vocabulary's end-of-word mark becomes a zero byte, and "last byte + mark" is
merged first, which is how the tokenizer starts a word.  Pieces beyond plain
Latin text go through the tokenizer itself, as do whole texts in which pieces
could depend on each other.
"""

from __future__ import annotations

import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: white space for Python that is none for the tokenizer, the start of special tokens, letters with special lower case
_WHOLE = re.compile("[\x00\x1c-\x1fΣİ]|<\\|")
_PLAIN = re.compile("[!-~¡-įı-ſ]+")
#: the tokenizer's own split of a piece (fixed value)
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_END = "</w>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as it is, others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.cache: dict[str, bytes] = {}
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        pieces = []
        for word, i in vocabulary.items():
            if word not in special and word != _END:
                end = word.endswith(_END)
                raw = bytes(letters[c] for c in (word[:-len(_END)] if end else word))
                pieces.append((len(raw) > 1, not end if len(raw) == 1 else False, i, raw + b"\0" * end))
        # single bytes, then single bytes with the mark, then merges in the order of their ids; rank 0 is the mark itself
        ranks[b"\0"] = 0
        ids.append(-1)
        for _, _, i, raw in sorted(pieces, key=lambda p: (p[0], not p[1], p[2])):
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(i)
        self.ids = np.array(ids, np.int64)
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for raw, r in ranks.items() if raw.endswith(b"\0")]] = True
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if _PLAIN.fullmatch(p)]
        for p in pieces:
            if not _PLAIN.fullmatch(p):
                self.cache[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return
        split = [_SPLIT.findall(p) for p in plain]
        ranks = np.array(self.merges.encode_ordinary("\0".join(w for words in split for w in words) + "\0"), np.int64)
        stops = np.flatnonzero(self.ends[ranks]) + 1
        raw = self.ids[ranks].astype("<u4").tobytes()
        at = word = 0
        for p, words in zip(plain, split, strict=True):
            word += len(words)
            to = int(stops[word - 1])
            self.cache[p] = raw[4 * at:4 * to]
            at = to

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; NULL has none."""
        if not text:
            return b""
        if _WHOLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces, out = text.lower().split(), []
        for i in range(0, len(pieces), 100_000):
            block = pieces[i:i + 100_000]
            new = set(block).difference(self.cache)
            if new:
                if len(self.cache) + len(new) > self.most:
                    self.cache.clear()
                    new = set(block)
                self.learn(list(new))
            out.append(b"".join(map(self.cache.__getitem__, block)))
        return b"".join(out)
