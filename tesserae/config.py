"""Settings: nested defaults, overridden by the first readable JSON file; lists are replaced, not merged."""

from __future__ import annotations

import copy
import json
from typing import Any

# Default settings.
DEFAULTS: dict[str, Any] = {
    "embedding": {"provider": "local", "dimensions": 384},
    "token_budgets": {"working": 16000, "session": 4000, "epoch": 2000, "core": 1000, "retrieval": 8000, "graph_facts": 2000, "default_retrieve": 8000},
    "compression": {"overflow_threshold": 20000, "consolidation_count": 10, "decay_rate": 0.01, "decay_interval_hours": 24},
    "ranking": {"semantic": 0.4, "recency": 0.3, "priority": 0.2, "frequency": 0.1, "dedup_threshold": 0.85},
    "session": {"auto_start": True},
}


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A new dict: over's values win, dicts merge deeply, None in over is skipped."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge(out[key], value)
        elif value is not None:
            out[key] = copy.deepcopy(value)
    return out


def load(paths: list[str] | tuple[str, ...] = ()) -> dict[str, Any]:
    """Defaults merged with the first path that can be read; a malformed file counts as none."""
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            continue
        return merge(DEFAULTS, found) if isinstance(found, dict) else copy.deepcopy(DEFAULTS)
    return copy.deepcopy(DEFAULTS)
