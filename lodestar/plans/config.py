"""Limits that shape results, by size of the installation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    max_k: int = 200
    max_candidates: int = 2000
    mmr_max_n: int = 1000
    write_batch_rows: int = 5000
    cache_entries: int = 512
    cache_threshold: float = 0.97
    restricted: bool = False

    def k(self, wanted: int) -> int:
        return max(0, min(wanted, self.max_k))

    def candidates(self, wanted: int) -> int:
        return max(0, min(wanted, self.max_candidates))

    def may_write(self) -> None:
        if self.restricted:
            raise PermissionError("writes are off in restricted mode")


#: max_k, max_candidates, mmr_max_n, write_batch_rows, cache_entries of each tier.
TIERS = {
    "mobile": Limits(20, 200, 100, 500, 0),
    "edge": Limits(100, 1000, 500, 2000, 128),
    "server": Limits(200, 2000, 1000, 5000, 512),
    "dc": Limits(1000, 20000, 5000, 10000, 4096),
}


def tier(memory_gib: float, cores: int = 1) -> str:
    if memory_gib >= 128:
        return "dc"
    if memory_gib >= 8:
        return "server"
    return "edge" if memory_gib >= 1 or cores >= 4 else "mobile"


def whole(value: object, default: int) -> int:
    """A non-negative whole number given as a number or as text, else the default."""
    try:
        found = int(str(value).strip()) if not isinstance(value, float) else int(value)
    except (TypeError, ValueError):
        return default
    return found if found >= 0 else default


def number(value: object, default: float) -> float:
    try:
        return float(str(value).strip())
    except (TypeError, ValueError):
        return default
