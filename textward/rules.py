"""The rule registry: what is looked for, in which order, and how Spark runs it.

A rule is a regular expression with a category, a vector name and a severity.
The order matters: the strip phase replaces the hits of rule *i* before rule
*i + 1* looks at the text, so an early rule can mask a later one.

Three things are kept apart on purpose:

``pattern``
    The published spelling, which defines what matches.  Unicode ``\\w \\s \\d``,
    ``.`` stops at a line feed only.
``linear``
    An optional spelling for the JVM that finds the same matches without deep
    recursion or repeated rescans (see the comment at each use).
``gate``
    Literals of which at least one group must occur in the case-folded text for
    the rule to be able to match: ``(("union", "select"),)`` reads
    "union and select".  An empty gate always lets the rule run.  A literal may
    not be part of the text ``[blocked]``; then a gate computed once before the
    strip phase stays valid for every later step, because stripping never joins
    two pieces of text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

BLOCKED = "[blocked]"

# Python's \s and \w, spelled as class members.
_SPACE = r"\x20\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"
_MEMBERS = {"s": _SPACE, "w": _WORD, "d": r"\p{Nd}"}
# With the flag U, \s of the JVM lacks only the four separators; one predicate
# and one range are much faster there than ten ranges.
_JAVA_MEMBERS = _MEMBERS | {"s": r"\s\x1c-\x1f"}


def _respell(pattern: str, inner: dict[str, str], outer: dict[str, str]) -> str:
    """Replace ``\\s \\w \\d \\S \\b`` inside and outside of bracket classes."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] == "\\":
            table = inner if in_class else outer
            repl = table.get(two[1], two)
            out.append(repl(pattern[i + 2:]) if callable(repl) else repl)
            i += 2
            continue
        if two[0] == "[":
            in_class = True
        elif two[0] == "]":
            in_class = False
        out.append(two[0])
        i += 1
    return "".join(out)


def _boundary(rest: str) -> str:
    """A ``\\b`` before a word is a look-behind, one after a word a look-ahead."""
    before_word = rest[:1].isalnum() or rest.startswith(("(", "_", "\\w"))
    return f"(?<![{_WORD}])" if before_word else f"(?![{_WORD}])"


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    """Spelling for ``java.util.regex``: Unicode case folding, Python's classes."""
    inner = dict(_JAVA_MEMBERS)
    outer = {k: f"[{v}]" for k, v in inner.items()} | {"S": f"[^{inner['s']}]", "b": _boundary}
    return "(?Ud)" + _respell(pattern, inner, outer)


@lru_cache(maxsize=None)
def to_re2(pattern: str) -> str:
    """Spelling for RE2 (used by the SQL cross-checks); ``\\b`` stays ASCII there."""
    inner = dict(_MEMBERS) | {"S": r"\S"}
    outer = {k: f"[{v}]" for k, v in _MEMBERS.items()}
    pattern = pattern.replace(r"[\s\S]", r"(?s:.)")
    pattern = re.sub(r"(?<!\\)\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
    return _respell(pattern, inner, outer)


@dataclass(frozen=True)
class Rule:
    category: str
    vector: str
    severity: str
    pattern: str
    gate: tuple[tuple[str, ...], ...] = ()
    linear: str | None = None
    # Cheap expressions of which one must match; they start with a character
    # class, which the JVM scans several times faster than a look-behind.
    probe: tuple[str, ...] = ()
    # For a ``linear`` spelling that has to look at text before the match: the
    # group holding the match, and the group to put back in front of it.
    group: int = 0
    keep: str = ""

    @property
    def java(self) -> str:
        return to_java(self.linear or self.pattern)

    @property
    def re2(self) -> str:
        return to_re2(self.pattern)

    @property
    def replacement(self) -> str:
        return self.keep + BLOCKED


def _any(*words: str) -> tuple[tuple[str, ...], ...]:
    return tuple((w,) for w in words)


def _each(first: str, *words: str) -> tuple[tuple[str, ...], ...]:
    return tuple((first, w) for w in words)


# --------------------------------------------------------------------------
# The detection patterns, in the order in which they are applied.
# Matching results must equal the published rule set, so the expressions are
# given literally.  Gates and linear spellings are ours.
# --------------------------------------------------------------------------

SQL = [
    Rule("sql_injection", "sql_drop_alter", "critical",
         r"(?i)\b(DROP|ALTER|TRUNCATE|DELETE\s+FROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET)\b\s",
         gate=_any("drop", "alter", "truncate", "delete", "insert", "update"),
         probe=(r"(?i:[dDaAtTiIuU\u0130\u0131](?:rop|lter|runcate|elete|nsert|pdate)\s)",)),
    Rule("sql_injection", "sql_union_select", "critical",
         r"(?i)\bUNION\s+(ALL\s+)?SELECT\b",
         gate=(("union", "select"),)),
    Rule("sql_injection", "sql_time_delay", "critical",
         r"(?i)\b(WAITFOR\s+DELAY|SLEEP\s*\(|BENCHMARK\s*\(|pg_sleep\s*\()",
         gate=_any("waitfor", "sleep", "benchmark"),
         probe=(r"(?i:[wWsSbB\u017f](?:aitfor\s|leep\s*+\(|enchmark\s*+\())",)),
    Rule("sql_injection", "sql_boolean_blind", "high",
         r"""(?i)\b(OR|AND)\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+['\"]?""",
         gate=_any("="),
         probe=(r"""\d['"]?+\s*+=\s*+['"]?+\d""",)),
    Rule("sql_injection", "sql_stacked_query", "critical",
         r"(?i);\s*(DROP|ALTER|EXEC|EXECUTE|xp_cmdshell|sp_executesql)",
         gate=_each(";", "drop", "alter", "exec", "xp_cmdshell")),
    Rule("sql_injection", "sql_comment_evasion", "high",
         r"(?i)/\*.*?(DROP|SELECT|UNION|INSERT|DELETE).*?\*/",
         gate=(("/*", "*/"),),
         # If the first comment opener of a line finds no keyword and end after
         # it, no later opener of the line does: try only the first one.
         linear=r"(?im)((?:\G|^)(?>(?:(?!/\*).)*+))(/\*(?>.*?(?:DROP|SELECT|UNION|INSERT|DELETE))(?>.*?\*/))",
         group=2, keep="$1"),
    Rule("sql_injection", "sql_hex_encoded", "medium",
         r"(?i)0x[0-9a-fA-F]{8,}",
         gate=_any("0x")),
]

CODE = [
    Rule("code_execution", "python_exec", "critical",
         r"(?i)\b(exec|eval|compile|__import__|getattr|setattr|delattr)\s*\(",
         gate=_each("(", "exec", "eval", "compile", "__import__", "attr")),
    Rule("code_execution", "python_os_exec", "critical",
         r"(?i)\b(os\.system|os\.popen|subprocess\.(call|run|Popen|check_output))\s*\(",
         gate=_any("os.system", "os.popen", "subprocess.")),
    Rule("code_execution", "python_deser", "critical",
         r"(?i)\b(pickle\.loads|marshal\.loads|yaml\.unsafe_load)\s*\(",
         gate=_any("pickle.loads", "marshal.loads", "yaml.unsafe_load")),
    Rule("code_execution", "shell_injection", "critical",
         r"(?i)(;\s*(?:rm\s|cat\s|wget\s|curl\s|chmod\s|chown\s|nc\s|bash\s|sh\s|python|perl|ruby))",
         gate=_any(";")),
    Rule("code_execution", "shell_pipe_exec", "critical",
         r"\|\s*(?:bash|sh|zsh|python|perl|ruby|nc|ncat)\b",
         gate=_any("|")),
    Rule("code_execution", "shell_backtick", "critical",
         r"`[^`]*(?:rm|cat|wget|curl|chmod|bash|sh|python)[^`]*`",
         gate=_any("`"),
         # One command word is enough; do not retry the others.
         linear=r"`(?>[^`]*?(?:rm|cat|wget|curl|chmod|bash|sh|python))[^`]*+`"),
    Rule("code_execution", "node_exec", "high",
         r"""(?i)\b(require\s*\(\s*['\"]child_process|process\.exit|process\.env)""",
         gate=_any("child_process", "process.e")),
]

XSS = [
    Rule("xss", "xss_script_tag", "critical",
         r"(?i)<\s*/??\s*script[\s>]",
         gate=(("<", "script"),),
         linear=r"(?i)<\s*+(?:/\s*+)?+script[\s>]"),
    Rule("xss", "xss_event_handler", "critical",
         r"""(?i)\bon\w+\s*=\s*['\"]""",
         gate=_any("="),
         probe=(r"""[oO][nN]\w++\s*+=\s*+['"]""",)),
    Rule("xss", "xss_js_uri", "critical",
         r"(?i)javascript\s*:",
         gate=_any("javascript")),
    Rule("xss", "xss_data_uri", "high",
         r"(?i)data\s*:\s*text/html",
         gate=_any("text/html")),
    Rule("xss", "xss_svg_event", "critical",
         r"(?i)<\s*svg[\s/].*?on\w+\s*=",
         gate=(("svg", "="),),
         # Walk word by word; the first "on" of a word decides for that word.
         linear=r"(?i)<\s*+svg[\s/](?>(?:[^\w\n]++|(?!(?>\w*?on)\w++\s*+=)\w++)*+)(?>\w*?on)\w++\s*+="),
    Rule("xss", "xss_css_expr", "high",
         r"(?i)(expression|behavior)\s*\(",
         gate=_any("expression", "behavior")),
    Rule("xss", "xss_css_import", "high",
         r"""(?i)@import\s+['\"]?(?:https?:|javascript:)""",
         gate=_any("@import")),
    Rule("xss", "xss_iframe", "high",
         r"(?i)<\s*iframe[\s>]",
         gate=_any("iframe")),
    Rule("xss", "xss_embed", "high",
         r"(?i)<\s*(object|embed|applet)[\s>]",
         gate=_each("<", "object", "embed", "applet")),
    Rule("xss", "xss_form_hijack", "high",
         r"(?i)<\s*form[\s>].*?action\s*=",
         gate=(("form", "action", "="),),
         linear=r"(?i)<\s*+form[\s>](?>.*?action\s*+=)"),
]

PROMPT = [
    Rule("prompt_injection", "prompt_system_override", "critical",
         r"(?i)(ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?))",
         gate=_any("ignore")),
    Rule("prompt_injection", "prompt_instruction_override", "critical",
         r"(?i)(new\s+instructions?|override\s+instructions?|forget\s+(your|all)\s+instructions?)",
         gate=_any("instruction")),
    Rule("prompt_injection", "prompt_role_manipulation", "critical",
         r"(?i)(you\s+are\s+now|act\s+as\s+if|pretend\s+(?:to\s+be|you\s+are)|your\s+new\s+role\s+is)",
         gate=(("now",), ("act", "if"), ("pretend",), ("new", "role"))),
    Rule("prompt_injection", "prompt_authority_claim", "high",
         r"(?i)(as\s+(?:an?\s+)?admin|with\s+admin\s+(?:access|privileges?)|authorized\s+by\s+(?:the\s+)?system)",
         gate=(("admin",), ("authorized", "system"))),
    Rule("prompt_injection", "prompt_jailbreak", "critical",
         r"(?i)(do\s+anything\s+now|DAN\s+mode|jailbreak|bypass\s+(?:safety|restrictions?|filters?))",
         gate=_any("anything", "mode", "jailbreak", "bypass")),
    Rule("prompt_injection", "prompt_data_exfil", "critical",
         r"(?i)(send\s+(?:all|this|the)\s+(?:the\s+)?(?:data|info|content|text)\s+to|exfiltrate|forward\s+(?:to|all)\s+)",
         gate=_any("send", "exfiltrate", "forward")),
    Rule("prompt_injection", "prompt_privilege_escalation", "critical",
         r"(?i)(escalat\w+\s+(?:my\s+)?(?:privileges?|permissions?|access)|grant\s+(?:me\s+)?(?:admin|root|sudo))",
         gate=(("escalat",), ("grant",))),
    Rule("prompt_injection", "prompt_hidden_marker", "critical",
         r"(?i)(BEGIN\s+HIDDEN\s+INSTRUCTIONS?|SYSTEM\s*:\s*override|ADMIN\s*:\s*execute)",
         gate=(("begin", "hidden"), ("override",), ("admin", "execute"))),
    Rule("prompt_injection", "prompt_trust_building", "high",
         r"(?i)(as\s+we\s+(?:discussed|agreed)\s+(?:earlier|before|previously)|you\s+already\s+(?:agreed|confirmed|said\s+you\s+would))",
         gate=(("discussed",), ("agreed",), ("already", "confirmed"), ("already", "said"))),
    Rule("prompt_injection", "prompt_incremental_escalation", "medium",
         r"(?i)(just\s+this\s+once|small\s+exception|bend\s+the\s+rules?\s+(?:a\s+)?(?:little|bit)|slightly\s+modify\s+(?:your|the)\s+(?:rules?|behavior))",
         gate=_any("just", "exception", "bend", "slightly")),
]

JSON = [
    Rule("json_injection", "json_system_field", "high",
         r"""(?i)["\']?\s*(?:system|role|__proto__|constructor|prototype)\s*["\']?\s*:\s*["\']""",
         gate=_each(":", "system", "role", "__proto__", "constructor", "prototype"),
         # A run of blanks is entered at its start only.
         linear=r"""(?i)(?:["']\s*+|(?<!\s)\s*+)(?:system|role|__proto__|constructor|prototype)\s*+(?:["']\s*+)?+:\s*+["']"""),
    Rule("json_injection", "json_script_field", "critical",
         r"""(?i)["\']?\s*(?:on\w+|src|href|action|formaction)\s*["\']?\s*:\s*["\'](?:javascript:|data:)""",
         gate=_each(":", "javascript:", "data:"),
         probe=(r"""(?i::\s*+["'](?:javascript:|data:))""",),
         linear=r"""(?i)(?:["']\s*+|(?<!\s)\s*+)(?:on\w++|src|href|action|formaction)\s*+(?:["']\s*+)?+:\s*+["'](?:javascript:|data:)"""),
]

ENCODING = [
    # A repeated group recurses once per repetition in java.util.regex and ends
    # the JVM on long input; a possessive repetition is a plain loop, and since
    # nothing follows the group it accepts the same text.
    Rule("encoding_evasion", "encoding_html_entities", "high",
         r"(?:&#(?:x[0-9a-fA-F]+|\d+);){4,}",
         gate=_any("&#"),
         linear=r"(?:&#(?:x[0-9a-fA-F]++|\d++);){4,}+"),
    Rule("encoding_evasion", "encoding_unicode_escape", "high",
         r"(?:\\u[0-9a-fA-F]{4}\s*){4,}",
         gate=_any("\\u"),
         linear=r"(?:\\u[0-9a-fA-F]{4}\s*+){4,}+"),
    Rule("encoding_evasion", "encoding_url_chain", "medium",
         r"(?:%[0-9a-fA-F]{2}){6,}",
         gate=_any("%"),
         linear=r"(?:%[0-9a-fA-F]{2}){6,}+"),
]

SSRF = [
    Rule("ssrf", "ssrf_internal_ip", "critical",
         r"(?:https?://)?(?:127\.0\.0\.1|localhost|0\.0\.0\.0|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})(?::\d+)?[/\s]",
         gate=_any("127.0.0.1", "localhost", "0.0.0.0", "10.", "172.", "192.168.")),
    Rule("ssrf", "ssrf_cloud_metadata", "critical",
         r"(?i)(?:169\.254\.169\.254|metadata\.google\.internal|metadata\.azure\.com)",
         gate=_any("169.254.169.254", "metadata.google.internal", "metadata.azure.com")),
    Rule("ssrf", "ssrf_file_protocol", "high",
         r"(?i)file://",
         gate=_any("file://")),
]

CSV = [
    Rule("csv_injection", "csv_formula_injection", "high",
         r"(?m)^[\s]*[=+@]\s*[A-Za-z(]",
         gate=_any("=", "+", "@"),
         probe=(r"[=+@]\s*+[A-Za-z(]",),
         # Enter each run of blanks once, at its start; what lies before its
         # first line start is put back.
         linear=r"(\A|(?![!-~])(?<!\s)(?:(?!\n)\s)*+\n)(\s*+[=+@]\s*+[A-Za-z(])",
         group=2, keep="$1"),
    Rule("csv_injection", "csv_dde_injection", "critical",
         r"(?i)(?:=\s*(?:cmd|IMPORTXML|IMPORTFEED|IMPORTHTML|IMPORTRANGE|IMAGE|HYPERLINK)\s*\()",
         gate=_each("=", "cmd", "import", "image", "hyperlink")),
]

RAG = [
    Rule("rag_poisoning", "rag_authority_doc", "critical",
         r"(?i)(this\s+document\s+(?:has|grants|contains)\s+(?:special|elevated|admin)\s+(?:authority|access|privileges?|permissions?))",
         gate=_any("document")),
    Rule("rag_poisoning", "rag_cross_doc_reference", "high",
         r"(?i)(as\s+(?:confirmed|stated|documented)\s+in\s+(?:the\s+)?(?:other|previous|companion)\s+document)",
         gate=_any("document")),
    Rule("rag_poisoning", "rag_time_delay", "critical",
         r"(?i)(activate\s+(?:on|after|when)|trigger\s+(?:on|after|at)\s+(?:date|time|condition)|time[_-]?bomb|delayed?\s+execution)",
         gate=_any("activate", "trigger", "bomb", "delay")),
    Rule("rag_poisoning", "rag_gradual_escalation", "high",
         r"(?i)(phase\s*[2-9]\s*(?:of\s+)?(?:the\s+)?(?:plan|attack|operation)|step\s*[2-9]\s*:\s*(?:escalate|expand|deepen))",
         gate=_any("phase", "step")),
    Rule("rag_poisoning", "rag_token_stuffing", "medium",
         r"(?:(?:[A-Z]{2,}\s+){5,}|(?:\b\w{1,2}\b\s+){10,})",
         probe=(r"[A-Z]{2}\s++[A-Z]{2}", r"\s\S{1,2}+\s++\S{1,2}+\s++\S{1,2}+\s"),
         # A match in capitals starts at the start of a run of capitals.
         linear=r"(?:(?<![A-Z])(?:[A-Z]{2,}+\s++){5,}+|(?:\b\w{1,2}\s++){10,}+)"),
]

HIDDEN = [
    Rule("hidden_content", "hidden_html_comment", "critical",
         r"<!--[\s\S]*?(?:instruction|execute|system|ignore|override|admin)[\s\S]*?-->",
         gate=(("<!--", "-->"),),
         # Only the first match is reported, and if the first opener fails all do.
         linear=r"(?s)\A(?>.*?(?=<!--))(<!--(?>.*?(?:instruction|execute|system|ignore|override|admin))(?>.*?-->))",
         group=1),
    Rule("hidden_content", "hidden_css_invisible", "high",
         r"(?i)(?:color\s*:\s*(?:white|#fff(?:fff)?|rgba?\s*\(\s*255\s*,\s*255\s*,\s*255)|font-size\s*:\s*0|display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?(?:\s*;|\s*}))",
         gate=_each(":", "color", "font-size", "display", "visibility", "opacity")),
    Rule("hidden_content", "hidden_zero_width", "high",
         r"[\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff]{3,}"),
    Rule("hidden_content", "hidden_bidi_control", "high",
         r"[\u2028\u2029\u202a-\u202e\u2066-\u2069]{2,}"),
    Rule("hidden_content", "hidden_base64_payload", "medium",
         r"(?:[A-Za-z0-9+/]{4}){20,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})"),
]

COMMENT_INSTRUCTIONS = Rule(
    "hidden_content", "html_comment_instructions", "critical",
    "(?i)" + HIDDEN[0].pattern, gate=HIDDEN[0].gate, linear="(?i)" + HIDDEN[0].linear, group=1)

COMMENT = r"<!--[\s\S]*?-->"
TAG = r"<[^>]+>"
TAG_START = r"<[a-zA-Z/]"
ZERO_WIDTH = r"[\u200b\u200c\u200d\u200e\u200f\u2060-\u2064\ufeff\u2028\u2029\u202a-\u202e\u2066-\u2069]"
BASE64 = r"(?:[A-Za-z0-9+/]{4}){8,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})"
_HIDING_CSS = (r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?|font-size\s*:\s*0"
               r"|color\s*:\s*(?:white|#fff(?:fff)?|rgba?\s*\(\s*255\s*,\s*255\s*,\s*255)")
HIDING_STYLE = rf"""(?i)style\s*=\s*["\'][^"\']*(?:{_HIDING_CSS})[^"\']*["\']"""
HIDING_STYLE_LINEAR = rf"""(?i)style\s*+=\s*+["'](?>[^"']*?(?:{_HIDING_CSS}))[^"']*+["']"""

# --------------------------------------------------------------------------

RULES: tuple[Rule, ...] = tuple(SQL + CODE + XSS + PROMPT + JSON + ENCODING + SSRF + CSV + RAG)

# The rules tried on decoded base64 text, in this order.
DECODED_RULES: tuple[Rule, ...] = tuple(SQL + CODE + XSS + PROMPT)


def registry(spark, rules=RULES):
    """The registry as a DataFrame, for joins against a detections table."""
    rows = [(i, r.category, r.vector, r.severity, r.pattern) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(
        rows, "rule_seq int, category string, vector string, severity string, pattern string")
