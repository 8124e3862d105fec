"""Path guard: normalise a destination and say whether it may be written."""

from __future__ import annotations

from .expr import let, q

# Blocked by plain prefix, so /etcetera is blocked as well.
SYSTEM_PREFIXES = ("/etc", "/usr", "/bin", "/sbin", "/var/run", "/run", "/proc", "/sys", "/dev")


def normalise_path(path: str, base: str = "'/'") -> str:
    """Absolute path without ``.``, ``..`` and doubled slashes; relative paths start at ``base``.

    Symbolic links are a matter of one machine's file system and not followed.
    """
    full = f"CASE WHEN startswith({path}, '/') THEN {path} ELSE concat({base}, '/', {path}) END"
    walk = (f"aggregate(split({full}, '/'), cast(array() as array<string>), (acc, p) -> CASE "
            "WHEN p IN ('', '.') THEN acc "
            "WHEN p = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
            "ELSE concat(acc, array(p)) END)")
    return f"concat('/', array_join({walk}, '/'))"


SYSTEM_REFUSAL = "refused, in a folder of the system: "
OUTSIDE_REFUSAL = "refused, outside the given root: "


def path_verdict(path: str, root: str) -> str:
    """NULL for an allowed destination, else the reason; system paths are checked first.

    ``path`` and ``root`` are expressions for normalised paths.
    """
    system = " OR ".join(f"startswith({path}, {q(p)})" for p in SYSTEM_PREFIXES)
    inside = f"({path} = {root} OR startswith({path}, concat({root}, '/')))"
    return (f"CASE WHEN {system} THEN concat({q(SYSTEM_REFUSAL)}, {path}) "
            f"WHEN NOT {inside} THEN concat({q(OUTSIDE_REFUSAL)}, {path}) END")
