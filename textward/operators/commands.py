"""Risky shell commands in a command log; rows are marked, never dropped.

The 17 kinds of command are given; the expressions are this package's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import name, q
from ..rules import Rule


def _rule(category: str, vector: str, severity: str, pattern: str, linear: str | None = None) -> Rule:
    return Rule(category, vector, severity, pattern, linear=linear)


_START = r"(?:^|[\s;&|(])"


def _then(verb: str, tail: str, stop: str = "|;") -> str:
    """JVM spelling of `verb`, later `tail`, with none of the characters `stop` between them.

    The first verb of a stretch without `stop` leaves most room for the tail, so the search settles on it: a
    command of a million verbs is read once, not once per verb.
    """
    return rf"(?:^|[{stop}])(?>[^{stop}]*?(?<=^|[\s;&|(])(?:{verb}))[^{stop}]*(?:{tail})"

COMMANDS = (
    _rule("exfiltration", "outbound_data", "high",
          _START + r"(?:curl|wget|nc|ncat)(?:\s[^|;]*)?(?:\s-d|\s--data|\s-F|\s--form|\s--upload|>)",
          _then(r"(?:curl|wget|nc|ncat)(?=\s|>)", r"\s-d|\s--data|\s-F|\s--form|\s--upload|>")),
    _rule("exfiltration", "pipe_to_interpreter", "critical",
          _START + r"(?:curl|wget)\s[^;]*\|\s*(?:sudo\s+)?(?:bash|sh|zsh|python[0-9.]*)(?:\s|$)",
          _then(r"(?:curl|wget)\s", r"\|\s*(?:sudo\s+)?(?:bash|sh|zsh|python[0-9.]*)(?:\s|$)", ";")),
    _rule("exfiltration", "file_transfer", "high", _START + r"(?:scp|rsync|ftp)\s"),
    _rule("destructive", "recursive_delete", "critical",
          _START + r"rm\s+(?:-[A-Za-z]+\s+)*(?:-[A-Za-z]*[rRf][A-Za-z]*|--recursive|--force)(?:\s|$)",
          # options before the one that counts, none of which does
          _START + r"rm\s++(?:-[A-Za-eg-qs-z&&[^R]]++\s++)*+(?:-[A-Za-eg-qs-z&&[^R]]*+[rRf][A-Za-z]*+|--recursive|--force)(?:\s|$)"),
    _rule("destructive", "disk_wipe", "critical", _START + r"(?:mkfs(?:\.[a-z0-9]+)?\s|dd\s[^|;]*of=|shred\s)",
          _START + r"(?:mkfs(?:\.[a-z0-9]+)?\s|shred\s)|" + _then(r"dd\s", "of=")),
    _rule("destructive", "git_rewrite", "high",
          _START + r"git\s+(?:push\s[^|;]*(?:--force|-f(?:\s|$))|reset\s[^|;]*--hard|clean\s[^|;]*-[a-z]*f)",
          "|".join((_then(r"git\s++push\s", r"--force|-f(?:\s|$)"), _then(r"git\s++reset\s", "--hard"), _then(r"git\s++clean\s", "-[a-z]*f")))),
    _rule("destructive", "device_write", "critical", r">\s*/dev/(?:sd|nvme|disk)"),
    _rule("privilege", "become_root", "high", _START + r"(?:sudo|doas|su|pkexec)(?:\s|$)"),
    _rule("privilege", "open_permissions", "high",
          _START + r"chmod\s[^|;]*(?:0?777|[24]7[0-7]{2}|[ugoa]*\+[rwx]*s|o\+w|a\+w)",
          _then(r"chmod\s", r"777|[24]7[0-7]{2}|\+[rwx]*s|[oa]\+w")),
    _rule("privilege", "chown_root", "high", _START + r"chown\s[^|;]*root", _then(r"chown\s", "root")),
    _rule("sensitive_file", "sensitive_read", "high",
          r"(?:\.env(?:[^A-Za-z0-9_]|$)|/etc/passwd|/etc/shadow|id_rsa|\.ssh/|credentials|\.aws/)"),
    _rule("sensitive_file", "read_to_network", "critical",
          _START + r"(?:cat|base64|xxd)\s[^;]*\|\s*(?:curl|wget|nc|ncat)(?:\s|$)",
          _then(r"(?:cat|base64|xxd)\s", r"\|\s*(?:curl|wget|nc|ncat)(?:\s|$)", ";")),
    _rule("reverse_shell", "bash_tcp", "critical", _START + r"bash\s+-i[^;]*/dev/tcp", _then(r"bash\s++-i", "/dev/tcp", ";")),
    _rule("reverse_shell", "netcat_shell", "critical",
          _START + r"(?:nc|ncat)\s[^|;]*-[a-z]*e\s*(?:/bin/)?(?:ba|z)?sh",
          _then(r"(?:nc|ncat)\s", r"-[a-z]*e\s*(?:/bin/)?(?:ba|z)?sh")),
    _rule("reverse_shell", "python_socket", "critical", _START + r"python[0-9.]*\s.*socket.*connect",
          # a line feed may be what follows the verb, but does not come later
          r"(?:^|\n)(?>[^\n]*?(?<=^|[\s;&|(])python[0-9.]*+[^\S\n])(?>[^\n]*?socket)[^\n]*connect"
          + "|" + _START + r"python[0-9.]*+\n(?>[^\n]*?socket)[^\n]*connect"),
    _rule("credential_harvest", "environment_dump", "high", _START + r"(?:printenv|env|set)\s*\|"),
    _rule("credential_harvest", "grep_secrets", "medium",
          _START + r"[ef]?grep\s[^|;]*(?:PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE)",
          _then(r"[ef]?grep\s", "PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE")),
)


def scan_commands(df: DataFrame, col: str, out: str = "warnings", rules=COMMANDS) -> DataFrame:
    """Add an array of warnings (category, vector, severity) to each command row."""
    text = name(col)
    cases = ", ".join(
        f"CASE WHEN {text} rlike {q('(?d)' + (r.linear or r.pattern))} THEN named_struct('category', {q(r.category)}, "
        f"'vector', {q(r.vector)}, 'severity', {q(r.severity)}) END" for r in rules)
    return df.withColumn(out, F.expr(f"array_compact(array({cases}))"))
