"""SQL spellings of the same computations, for a cross-check by another engine.

They follow the rule order step by step with RE2 expressions and window
functions, independent of the gates and spellings used on Spark.
"""

from __future__ import annotations

from .. import rules as R
from ..limits import BASE64_REMOVED, DEFAULT_LIMITS, OVERSIZE_TEXT, RENDERING_CONTEXTS, TRUNCATED_SUFFIX, Limits


# RE2 has neither a Unicode \b nor look-behind: take the character before along.
NOT_WORD = R.to_re2(r"[^\w]")
SHORT_TOKENS = R.to_re2(r"(^|[^\w])(?:\w{1,2}\s+){10,}|(?:[A-Z]{2,}\s+){5,}")


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(texts, key: str) -> str:
    return f"([{', '.join(map(s, texts))}])[{key} % {len(texts)} + 1]"


def spliced(col: str, texts, key: str) -> str:
    return f"{col} || ' ' || {pick(texts, key)}"


def det(category, vector, severity, matched, action="stripped") -> str:
    return (f"{{'category': {s(category)}, 'vector': {vector}, 'severity': {s(severity)},"
            f" 'matched': left({matched}, 200), 'action': {s(action)}}}")


NONE = ("CAST([] AS STRUCT(category VARCHAR, vector VARCHAR, severity VARCHAR, matched VARCHAR, action VARCHAR)[])")


def _one(cond: str, d: str) -> str:
    return f"list_concat(d, CASE WHEN {cond} THEN [{d}] ELSE {NONE} END)"


class Steps:
    """A chain of common table expressions over (id, n, blocked, t, d)."""

    def __init__(self, source: str):
        self.ctes = [f"c0 AS ({source})"]
        self.columns = "id, n, blocked"
        self.add("length(raw) AS n, false AS blocked, raw AS t, " + NONE + " AS d", "id", "")

    @property
    def last(self) -> str:
        return f"c{len(self.ctes) - 1}"

    def add(self, select: str, columns: str | None = None, tail: str = "") -> None:
        cols = self.columns if columns is None else columns
        self.ctes.append(f"c{len(self.ctes)} AS (SELECT {cols}, {select} FROM {self.last} {tail})")

    def report_first(self, rule: R.Rule, action="stripped"):
        m = f"regexp_extract(t, {s(rule.re2)}, 0)"
        self.add(f"t, {_one(f'{m} <> {s('')}', det(rule.category, s(rule.vector), rule.severity, f'left({m}, 100)', action))} AS d")

    def limits(self, lim: Limits):
        seen = f"format('Content size {{:,}} bytes exceeds {lim.max_bytes:,} byte limit', strlen(t))"
        big = f"strlen(t) > {lim.max_bytes}"
        self.add(f"{big} AS blocked, CASE WHEN {big} THEN {s(OVERSIZE_TEXT)} ELSE t END AS t, "
                 + _one(big, det("resource_exhaustion", "'input_size_exceeded'", "critical", seen, "blocked")) + " AS d", "id, n")
        long = f"length(t) > {lim.max_chars}"
        seen = f"'Content length ' || length(t) || ' exceeds max {lim.max_chars}'"
        self.add(f"CASE WHEN {long} THEN left(t, {lim.max_chars}) || {s(TRUNCATED_SUFFIX).replace(chr(10), chr(10))} ELSE t END AS t, "
                 + _one(long, det("resource_exhaustion", "'token_exhaustion'", "high", seen, "truncated")) + " AS d")

    def nesting(self, lim: Limits):
        src = self.last
        self.ctes.append(f"""nb{len(self.ctes)} AS (SELECT id, max(x - least(0, low)) AS depth FROM (
            SELECT id, i, x, min(x) OVER (PARTITION BY id ORDER BY i) AS low FROM (
            SELECT id, i, sum(CASE WHEN ch IN ('{{', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS x FROM (
            SELECT id, unnest(b) AS ch, generate_subscripts(b, 1) AS i FROM (
            SELECT id, regexp_extract_all(t, '[{{}}\\[\\]]') AS b FROM {src})))) GROUP BY id)""")
        nb = self.ctes[-1].split(" ")[0]
        deep = f"coalesce(depth, 0) > {lim.max_depth}"
        seen = f"'Nesting depth ' || CAST(depth AS BIGINT) || ' exceeds max {lim.max_depth}'"
        self.ctes.append(
            f"c{len(self.ctes)} AS (SELECT id, n, blocked, CASE WHEN {deep} THEN regexp_replace(t, '[{{}}\\[\\]]{{3,}}', '...', 'g') "
            f"ELSE t END AS t, {_one(deep, det('resource_exhaustion', s('json_nesting_bomb'), 'high', seen, 'blocked'))} AS d "
            f"FROM {src} LEFT JOIN {nb} USING (id))")

    def unicode(self, lim: Limits):
        self.add("nfc_normalize(t) AS t, d")
        letters = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
        odd = r"length(regexp_replace(t, '[^\p{L}]|[\x00-\x7F]', '', 'g'))"
        self.add(f"t, d, {odd} / greatest({letters}, 1) AS ratio")
        high = f"ratio > {lim.homoglyph_ratio}"
        self.add(f"CASE WHEN {high} THEN regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g') ELSE t END AS t, "
                 + _one(high, det("encoding_evasion", "'homoglyph_attack'", "high",
                                  "'Homoglyph ratio: ' || printf('%.1f', ratio * 100) || '%'", "normalized")) + " AS d")
        clean = f"regexp_replace(t, {s(R.to_re2(R.ZERO_WIDTH))}, '', 'g')"
        gone = f"(length(t) - length({clean}))"
        self.add(f"{clean} AS t, " + _one(f"{gone} > 0", det(
            "hidden_content", "'zero_width_chars'", "high", f"'Removed ' || {gone} || ' invisible characters'")) + " AS d")

    def hidden(self):
        self.report_first(R.COMMENT_INSTRUCTIONS)
        self.add(f"regexp_replace(t, {s(R.to_re2(R.COMMENT))}, '', 'g') AS t, d")
        for rule in R.HIDDEN:
            self.report_first(rule)
        self.add(f"regexp_replace(t, {s(R.to_re2(R.HIDING_STYLE))}, '', 'g') AS t, d")

    def base64(self):
        cases = " ".join(f"WHEN regexp_matches(x, {s(r.re2)}) THEN {s(r.vector)}" for r in R.DECODED_RULES)
        segments = f"regexp_extract_all(t, {s(R.BASE64)})"
        # a blob shows quotes, backslashes and all bytes outside ASCII as \\xNN
        decoded = "CAST(from_base64(y) AS VARCHAR)"
        for code, char in ((r"\x22", '"'), (r"\x27", "'"), (r"\x5C", "\x01")):
            decoded = f"replace({decoded}, {s(code)}, {s(char)})"
        decoded = rf"regexp_replace({decoded}, '\\x[0-9A-F]{{2}}', '', 'g')"
        hit = (f"list_filter(list_transform(list_transform({segments}, lambda y: {decoded}), "
               f"lambda x: CASE {cases} END), lambda z: z IS NOT NULL)[1]")
        self.add(f"t, d, {hit} AS hit")
        self.add(f"CASE WHEN hit IS NOT NULL THEN regexp_replace(t, {s(R.BASE64)}, {s(BASE64_REMOVED)}, 'g') ELSE t END AS t, "
                 + _one("hit IS NOT NULL", det("encoding_evasion", "'base64_encoded_' || hit", "critical",
                                              "'Base64-encoded attack payload detected'")) + " AS d")

    def strip(self, rules):
        for r in rules:
            p, by, hit = s(r.re2), "[blocked]", "x"
            if r.vector == "rag_token_stuffing":
                p, by, hit = s(SHORT_TOKENS), r"\1[blocked]", f"regexp_replace(x, {s('^' + NOT_WORD)}, '')"
            d = det(r.category, s(r.vector), r.severity, f"left({hit}, 100)")
            self.add(f"regexp_replace(t, {p}, '{by}', 'g') AS t, "
                     f"list_concat(d, list_transform(regexp_extract_all(t, {p}), lambda x: {d})) AS d")

    def tags(self):
        n = f"len(regexp_extract_all(t, {s(R.TAG)}))"
        cond = f"regexp_matches(t, {s(R.TAG_START)}) AND {n} > 0"
        self.add(f"CASE WHEN {cond} THEN regexp_replace(t, {s(R.TAG)}, '', 'g') ELSE t END AS t, " + _one(cond, det(
            "xss", "'residual_html_tags'", "medium", f"{n} || ' HTML tags remaining after pattern strip'")) + " AS d")

    def escape(self, context: str):
        if context in RENDERING_CONTEXTS:
            t = "t"
            for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
                t = f"replace({t}, {s(ch)}, {s(entity)})"
            self.add(f"{t} AS t, d")

    def query(self, select: str) -> str:
        return "WITH " + ",\n".join(self.ctes) + f"\n{select.format(last=self.last)}"


def sanitize_sql(source: str, select: str, context: str = "general", rules=R.RULES, lim: Limits = DEFAULT_LIMITS) -> str:
    """The cleaning steps over ``source`` (id, raw); ``select`` reads ``{last}`` (id, n, blocked, t, d).

    Runs of more than 500 equal characters, which need a back reference, are
    left out; the sources used with it hold none.
    """
    steps = Steps(source)
    steps.limits(lim)
    steps.nesting(lim)
    steps.unicode(lim)
    steps.hidden()
    steps.base64()
    steps.strip(rules)
    steps.tags()
    steps.escape(context)
    return steps.query(select)
