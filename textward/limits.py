"""Thresholds and the texts they produce."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # The published defaults.
    max_bytes: int = 100 * 1024 * 1024
    max_chars: int = 50_000
    max_repeat: int = 500
    max_depth: int = 10
    homoglyph_ratio: float = 0.3
    audit_rows: int = 5_000
    summary_items: int = 6
    sprint_lines: int = 120


DEFAULT_LIMITS = Limits()

# Texts put in place of content.
OVERSIZE_TEXT = "[content blocked: exceeds maximum input size]"
TRUNCATED_SUFFIX = "\n[...content truncated for security...]"
NESTING_TEXT = "[nesting-limit]"
BASE64_REMOVED = "[base64-removed]"
RENDERING_CONTEXTS = ("diary", "html", "rendering")
