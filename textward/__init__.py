"""Content-safety analytics on Spark: scan, clean and report on untrusted text."""

from .limits import DEFAULT_LIMITS, Limits
from .operators.detect import detect
from .operators.sanitize import sanitize, sanitize_for_diary, sanitize_for_markdown
from .rules import RULES, Rule
from .session import build_session

__all__ = ["DEFAULT_LIMITS", "Limits", "RULES", "Rule", "build_session", "detect", "sanitize",
           "sanitize_for_diary", "sanitize_for_markdown"]
