"""Size strings such as "1g", "500 mb" or "1000r"."""

from __future__ import annotations

import re

_UNITS = {"g": 1024**3, "m": 1024**2, "k": 1024, "b": 1}
_SIZE = re.compile(r"\s*([0-9]*\.?[0-9]+)\s*([gmk])?b?\s*$", re.I)


def _bytes(size: str | float, bare: int) -> float:
    """Bytes of a size; a number without unit counts in ``bare`` bytes."""
    if isinstance(size, (int, float)) and not isinstance(size, bool):
        return size * bare
    text = str(size)
    found = _SIZE.match(text)
    if not found:
        raise ValueError(f"not a size: {size!r}")
    if found[2]:
        return float(found[1]) * _UNITS[found[2].lower()]
    return float(found[1]) * (1 if text.strip().lower().endswith("b") else bare)


def cache_gb(size: str | float) -> float:
    """A cache size in GB; a bare number is GB."""
    return _bytes(size, _UNITS["g"]) / _UNITS["g"]


def chunk_bytes(size: str | float) -> int:
    """A chunk size in bytes; a bare number is bytes."""
    return int(_bytes(size, 1))


def chunk_rows(size: str | float, width: int) -> int:
    """A chunk size in rows: "1000r" says so itself; of bytes, half are rows of ``width`` bytes."""
    text = str(size).strip().lower()
    if text.endswith("r"):
        return int(text[:-1])
    return max(1, chunk_bytes(size) // (2 * width))
