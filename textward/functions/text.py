"""The cleaning pipeline for one text value, as Spark SQL expressions.

A value travels as a small struct: ``t`` the text so far, ``n`` its original
length, ``blocked`` whether the size limit replaced it, ``d`` the detections.
Between the two halves, ``early_stages`` and ``late_stages``, lies the Unicode
step, which needs an Arrow function (see ``unicode.py``).

The analyzer binds one level of lambda variables per pass, so the caller puts
each stage into a projection of its own; the optimizer merges them again.
"""

from __future__ import annotations

from .. import rules as R
from ..limits import (BASE64_REMOVED, DEFAULT_LIMITS, OVERSIZE_TEXT, RENDERING_CONTEXTS,
                      TRUNCATED_SUFFIX, Limits)
from .expr import (NO_DETECTIONS, contains_all, detection, each, is_ascii, let, q, remove_spans,
                   replace, split_at_last, struct, when)
from .gates import Gates
from .unicode import ratio_if_above

EARLY = ("t", "a", "n", "blocked", "d")     # a: ASCII form, set by the Unicode step
LATE = ("t", "f", "n", "blocked", "d")      # f: gate literals found in the text


def _with(s: str, fields, found: str | None = None, **changed: str) -> str:
    """The state ``s`` with some fields changed and one detection array added."""
    if found is not None:
        changed["d"] = f"concat({s}.d, {found})"
    return struct(**{f: changed.get(f, f"{s}.{f}") for f in fields})


def _step(state: str, cond, body) -> str:
    """Apply ``body`` to the state where ``cond`` holds; a text that the size limit replaced is left as it is."""
    return let(state, lambda s: when(f"NOT {s}.blocked AND ({cond(s)})", body(s), s))


# ----------------------------------------------------------------- limits

def start(text: str) -> str:
    return struct(t=text, a="cast(NULL as string)", n=f"length({text})", blocked="false", d=NO_DETECTIONS)


def limit_size(state: str, limits: Limits) -> str:
    def block(s):
        seen = (f"concat('Content size ', format_number(octet_length({s}.t), 0), ' bytes exceeds ',"
                f" format_number({limits.max_bytes}, 0), ' byte limit')")
        found = detection("resource_exhaustion", "input_size_exceeded", "critical", seen, "blocked")
        return _with(s, EARLY, f"array({found})", t=q(OVERSIZE_TEXT), blocked="true")

    return _step(state, lambda s: f"octet_length({s}.t) > {limits.max_bytes}", block)


def limit_length(state: str, limits: Limits) -> str:
    def cut(s):
        seen = f"concat('Content length ', length({s}.t), ' exceeds max {limits.max_chars}')"
        found = detection("resource_exhaustion", "token_exhaustion", "high", seen, "truncated")
        return _with(s, EARLY, f"array({found})", t=f"concat(left({s}.t, {limits.max_chars}), {q(TRUNCATED_SUFFIX)})")

    return _step(state, lambda s: f"length({s}.t) > {limits.max_chars}", cut)


def collapse_runs(state: str, limits: Limits) -> str:
    n = limits.max_repeat
    run = rf"(?d)(.)\1{{{n},}}+"
    # A run of n + 1 covers one whole block of an even division of the text, so
    # clean text is dismissed block by block.
    block = (n + 2) // 2
    has_block = rf"(?s)\A(?:.{{{block}}})*?(.)\1{{{block - 1}}}"

    def strip(s):
        def with_first(first):
            seen = f"concat('Repeated char \\'', left({first}, 1), '\\' x', length({first}))"
            found = detection("resource_exhaustion", "context_window_stuffing", "high", seen, "stripped")
            return when(f"{first} != ''", _with(s, EARLY, f"array({found})", t=replace(f"{s}.t", run, "$1$1$1...")), s)

        return let(f"regexp_extract({s}.t, {q(run)}, 0)", with_first)

    return _step(state, lambda s: f"length({s}.t) > {n} AND {s}.t rlike {q(has_block)}", strip)


def nesting_depth(text: str) -> str:
    """Deepest level of ``{`` and ``[``; closers never go below zero."""
    brackets = f"split({replace(text, r'[^{}\[\]]+', '')}, '')"
    depth = ("CASE WHEN c IN ('{', '[') THEN acc.depth + 1 WHEN c IN ('}', ']') THEN greatest(acc.depth - 1, 0)"
             " ELSE acc.depth END")
    return (f"aggregate({brackets}, named_struct('depth', 0, 'deepest', 0), (acc, c) -> "
            f"named_struct('depth', {depth}, 'deepest', greatest(acc.deepest, {depth})), acc -> acc.deepest)")


def flatten_nesting(state: str, limits: Limits) -> str:
    # Depth d needs d openers.
    openers = rf"\A(?>[^{{\[]*+[{{\[]){{{limits.max_depth + 1}}}"

    def flatten(s):
        def with_depth(depth):
            seen = f"concat('Nesting depth ', {depth}, ' exceeds max {limits.max_depth}')"
            found = detection("resource_exhaustion", "json_nesting_bomb", "high", seen, "blocked")
            return when(f"{depth} > {limits.max_depth}",
                        _with(s, EARLY, f"array({found})", t=replace(f"{s}.t", r"[{}\[\]]{3,}", "...")), s)

        return let(nesting_depth(f"{s}.t"), with_depth)

    maybe = lambda s: f"(contains({s}.t, '{{') OR contains({s}.t, '[')) AND {s}.t rlike {q(openers)}"
    return _step(state, maybe, flatten)


def early_stages(limits: Limits = DEFAULT_LIMITS):
    def stage(text):
        state = start(text)
        for step in (limit_size, limit_length, collapse_runs, flatten_nesting):
            state = step(state, limits)
        return state

    return [stage]


# ---------------------------------------------------------------- unicode

def fold_homoglyphs(state: str, limits: Limits) -> str:
    """Use the ASCII form where too many letters lie outside ASCII (lossy)."""
    def check(s):
        def with_ratio(r):
            seen = f"concat('Homoglyph ratio: ', format_number({r} * 100, 1), '%')"
            found = detection("encoding_evasion", "homoglyph_attack", "high", seen, "normalized")
            return when(f"{r} > {limits.homoglyph_ratio}D", _with(s, EARLY, f"array({found})", t=f"{s}.a"), s)

        return let(ratio_if_above(f"{s}.t", limits.homoglyph_ratio), with_ratio)

    return _step(state, lambda s: f"{s}.a IS NOT NULL", check)


def strip_zero_width(state: str) -> str:
    def strip(s):
        def with_rest(rest):
            gone = f"length({s}.t) - length({rest})"
            found = detection("hidden_content", "zero_width_chars", "high",
                              f"concat('Removed ', {gone}, ' invisible characters')", "stripped")
            return when(f"{gone} > 0", _with(s, EARLY, f"array({found})", t=rest), s)

        # one range first: a much cheaper test for most characters
        return let(replace(f"{s}.t", r"(?=[\u200b-\ufeff])" + R.ZERO_WIDTH, ""), with_rest)

    return _step(state, lambda s: rf"NOT {is_ascii(s + '.t')} AND {s}.t rlike {q(r'[\u200b-\u206f\ufeff]')}", strip)


# --------------------------------------------------------- hidden content

def strip_comments(text: str) -> str:
    return when(contains_all(text, "<!--", "-->"), remove_spans(text, R.COMMENT, "-->"), text)


def first_match(text: str, rule: R.Rule) -> str:
    return f"regexp_extract({text}, {q(rule.java)}, {rule.group})"


def _report_first(state: str, fields, rule: R.Rule, maybe) -> str:
    """Report the first match of a rule and leave the text alone."""
    def with_first(s, first):
        found = detection(rule.category, rule.vector, rule.severity, f"left({first}, 100)", "stripped")
        return when(f"{first} != ''", _with(s, fields, f"array({found})"), s)

    return _step(state, maybe, lambda s: let(first_match(f"{s}.t", rule), lambda m: with_first(s, m)))


# A run of 36 covers one whole block of 18 of an even division of the text.
_BASE64_BLOCK = r"(?s)\A(?:.{18})*?[A-Za-z0-9+/]{18}"

_CSS = next(r for r in R.HIDDEN if r.vector == "hidden_css_invisible")


def report_comment(state: str) -> str:
    return _report_first(state, EARLY, R.COMMENT_INSTRUCTIONS, lambda s: contains_all(f"{s}.t", "<!--", "-->"))


def drop_comments(gates: Gates):
    def stage(state):
        return let(state, lambda s: let(strip_comments(f"{s}.t"), lambda t: struct(
            t=t, f=gates.found_in(t), n=f"{s}.n", blocked=f"{s}.blocked", d=f"{s}.d")))

    return stage


def report_hidden(state: str, gates: Gates) -> str:
    for rule in R.HIDDEN:
        if rule.vector in ("hidden_zero_width", "hidden_bidi_control"):
            continue        # those characters are gone by now; see operators.detect
        if rule.vector == "hidden_html_comment":
            maybe = lambda s: contains_all(f"{s}.t", "<!--", "-->")
        elif rule.vector == "hidden_base64_payload":
            maybe = lambda s: f"{s}.t rlike {q(_BASE64_BLOCK)}"
        else:
            maybe = lambda s, r=rule: gates.open(f"{s}.f", r)
        state = _report_first(state, LATE, rule, maybe)
    return state


def drop_styles(gates: Gates):
    """Remove style attributes that hide content; joined text needs new gates."""
    pattern = R.to_java(R.HIDING_STYLE_LINEAR)

    def stage(state):
        def drop(s):
            return let(replace(f"{s}.t", pattern, ""), lambda t: when(
                f"length({t}) < length({s}.t)", _with(s, LATE, t=t, f=gates.found_in(t)), s))

        return _step(state, lambda s: gates.has(f"{s}.f", "style"), drop)

    return stage


# ----------------------------------------------------------------- base64

def decoded_text(segment: str) -> str:
    """Base64 to text; bytes that are not valid UTF-8 are dropped."""
    raw = f"replace(cast(unbase64({segment}) as string), '\ufffd', '\\u0001')"
    return f"replace(make_valid_utf8({raw}), '\ufffd', '')"


def base64_threat(segments: str, rules=R.DECODED_RULES) -> str:
    """Vector name of the first rule hit over (segment, rule), or NULL."""
    def first_rule(text):
        return "CASE " + " ".join(f"WHEN {text} rlike {q(r.java)} THEN {q(r.vector)}" for r in rules) + " END"

    return f"get(filter({each(each(segments, decoded_text), first_rule)}, x -> x IS NOT NULL), 0)"


def rescan_base64(state: str) -> str:
    def with_hit(s, vector):
        found = struct(category="'encoding_evasion'", vector=f"concat('base64_encoded_', {vector})", severity="'critical'",
                       matched="'Base64-encoded attack payload detected'", action="'stripped'")
        return when(f"{vector} IS NOT NULL",
                    _with(s, LATE, f"array({found})", t=replace(f"{s}.t", R.BASE64, BASE64_REMOVED)), s)

    def scan(s):
        segments = f"regexp_extract_all({s}.t, {q(R.BASE64)}, 0)"
        return let(base64_threat(segments), lambda v: with_hit(s, v))

    return _step(state, lambda s: f"{s}.t rlike {q(_BASE64_BLOCK)}", scan)


# ------------------------------------------------------------- strip rules

def rule_matches(text: str, rule: R.Rule) -> str:
    probes = " OR ".join(f"{text} rlike {q(R.to_java(p))}" for p in rule.probe)
    return (f"({probes}) AND " if probes else "") + f"{text} rlike {q(rule.java)}"


def rule_hits(text: str, rule: R.Rule) -> str:
    return f"regexp_extract_all({text}, {q(rule.java)}, {rule.group})"


def hits_to_detections(hits: str, rule: R.Rule, action: str = "stripped") -> str:
    return each(hits, lambda h: detection(rule.category, rule.vector, rule.severity, f"left({h}, 100)", action))


def strip_rule(state: str, rule: R.Rule, gates: Gates) -> str:
    """One detection per match, every match replaced, text passed on."""
    def strip(s):
        return _with(s, LATE, hits_to_detections(rule_hits(f"{s}.t", rule), rule),
                     t=replace(f"{s}.t", rule.java, rule.replacement))

    return _step(state, lambda s: f"{gates.open(s + '.f', rule)} AND {rule_matches(s + '.t', rule)}", strip)


def strip_tags(text: str) -> str:
    return when(f"contains({text}, '>')", remove_spans(text, R.TAG, ">"), text)


def residual_tags(state: str) -> str:
    def strip(s):
        def on_parts(head, tail):
            def with_count(n):
                found = detection("xss", "residual_html_tags", "medium",
                                  f"concat({n}, ' HTML tags remaining after pattern strip')", "stripped")
                return when(f"{n} > 0", _with(s, LATE, f"array({found})", t=f"concat({replace(head, R.TAG, '')}, {tail})"), s)

            return let(f"regexp_count({head}, {q(R.TAG)})", with_count)

        return split_at_last(f"{s}.t", ">", on_parts)

    return _step(state, lambda s: f"{contains_all(s + '.t', '<', '>')} AND {s}.t rlike {q(R.TAG_START)}", strip)


def escape_html(text: str) -> str:
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {q(ch)}, {q(entity)})"
    return text


def escape_for(text: str, context: str) -> str:
    """Escape where the context, a SQL expression, is one that gets rendered."""
    names = ", ".join(map(q, RENDERING_CONTEXTS))
    return when(f"{context} IN ({names})", escape_html(text), text)


def late_stages(context: str = "'general'", limits: Limits = DEFAULT_LIMITS, rules=R.RULES, per_stage: int = 8):
    """The rest of the pipeline; the last stage gives ``struct<t, n, c, d>`` (c: cleaned length)."""
    gates = Gates([*rules, _CSS], extra=("style",))

    def chain(some):
        def all_of(state):
            for rule in some:
                state = strip_rule(state, rule, gates)
            return state

        # most texts open no gate of a stage and pass it in one step
        return lambda state: _step(state, lambda s: gates.any_open(f"{s}.f", some), all_of)

    def finish(state):
        return let(residual_tags(state), lambda s: let(escape_for(f"{s}.t", context), lambda t: struct(
            t=t, n=f"{s}.n", c=when(f"{s}.blocked", "0", f"length({t})"), d=f"{s}.d")))

    first = [lambda s: strip_zero_width(fold_homoglyphs(s, limits)), report_comment, drop_comments(gates),
             lambda s: report_hidden(s, gates), drop_styles(gates), rescan_base64]
    return first + [chain(rules[i:i + per_stage]) for i in range(0, len(rules), per_stage)] + [finish]
