"""Cheap tests that tell which rules a text can possibly match."""

from __future__ import annotations

import re

from ..rules import Rule
from .expr import each, fold_case, let, q

# Letters from rare to frequent; anything else (signs, digits) is rarer still.
_RARITY = "zqjxkvbpygfwmucldrhsnioate"
# of a long, without its sign
_BITS = 63


def _anchor(word: str) -> int:
    return min(range(len(word)), key=lambda i: _RARITY.find(word[i]))


def token(word: str) -> str:
    """What the gate pattern reports for a literal: the part from its rarest letter on."""
    return word[_anchor(word):]


def pattern_of(words) -> str:
    """One expression that finds all literals in one pass over folded text.

    A literal is recognised at its rarest letter, so that most positions are
    dismissed by a single character test; trying every literal at every letter
    costs fifty times as much.  Longer tokens come first, hence a token that is
    a prefix of another one may be reported as the longer one.
    """
    by_letter: dict[str, set[tuple[str, str]]] = {}
    for w in words:
        i = _anchor(w)
        by_letter.setdefault(w[i], set()).add((w[:i], w[i + 1:]))
    def branch(letter):
        ordered = sorted(by_letter[letter], key=lambda e: (-len(e[1]), e))
        return re.escape(letter) + "(?:" + "|".join(
            re.escape(after) + (f"(?<={re.escape(before + letter + after)})" if before else "")
            for before, after in ordered) + ")"

    def one_of(letters):
        return f"(?=[{''.join(map(re.escape, letters))}])"

    # groups of six: two short searches instead of a long one
    frequent_first = sorted(by_letter, key=_RARITY.find, reverse=True)
    groups = [frequent_first[i:i + 6] for i in range(0, len(frequent_first), 6)]
    found = "|".join(f"{one_of(g)}(?:{'|'.join(map(branch, g))})" for g in groups)
    return f"{one_of(frequent_first)}(?=({found}))"


class Gates:
    """The gate literals of some rules, searched for in one pass per text."""

    def __init__(self, rules, extra=()):
        words = [w for r in rules for group in r.gate for w in group] + list(extra)
        self.words = list(dict.fromkeys(words))
        self.tokens = sorted({token(w) for w in self.words})

    def found_in(self, text: str) -> str:
        """The tokens that occur in the text, as an array of numbers with a bit for each."""
        hits = f"array_distinct(regexp_extract_all({fold_case(text)}, {q(pattern_of(self.words))}, 1))"
        known = f"array({', '.join(map(q, self.tokens))})"
        n = -(-len(self.tokens) // _BITS)

        def words(at):
            def word(j):
                mine = "" if n == 1 else f"WHEN p < {j * _BITS} OR p >= {(j + 1) * _BITS} THEN m "
                return f"aggregate({at}, 0L, (m, p) -> CASE {mine}ELSE m | shiftleft(1L, cast(p - {j * _BITS} as int)) END)" if mine else (
                    f"aggregate({at}, 0L, (m, p) -> m | shiftleft(1L, cast(p as int)))")

            return f"array({', '.join(map(word, range(n)))})"

        return let(each(hits, lambda t: f"(array_position({known}, {t}) - 1)"), words)

    def any_found(self, found: str) -> str:
        return self._some(found, self.tokens)

    def has(self, found: str, *words: str) -> str:
        """Whether one of the words may be in the text the tokens come from."""
        return self._some(found, [t for t in self.tokens if any(t.startswith(token(w)) for w in words)])

    def _some(self, found: str, tokens) -> str:
        masks: dict[int, int] = {}
        for t in tokens:
            j, bit = divmod(self.tokens.index(t), _BITS)
            masks[j] = masks.get(j, 0) | 1 << bit
        return "(" + " OR ".join(f"(get({found}, {j}) & {m}L) <> 0L" for j, m in sorted(masks.items())) + ")"

    def open(self, found: str, rule: Rule) -> str:
        """Whether the found tokens allow the rule to match."""
        if not rule.gate:
            return "true"
        single = [g[0] for g in rule.gate if len(g) == 1]
        conds = [self.has(found, *single)] if single else []
        conds += ["(" + " AND ".join(self.has(found, w) for w in g) + ")" for g in rule.gate if len(g) > 1]
        return "(" + " OR ".join(conds) + ")"

    def any_open(self, found: str, rules) -> str:
        if any(not r.gate for r in rules):
            return "true"
        return self.has(found, *(g[0] for r in rules for g in r.gate))
