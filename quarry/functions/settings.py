"""Settings: defaults, a project's own, and those of a call, the later over the earlier."""

from __future__ import annotations

from typing import Any


def merged(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """One table of all layers. Tables are merged key by key; lists and values of a later layer replace an earlier's, and None replaces nothing."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            if isinstance(value, dict):
                known = out.get(key)
                out[key] = merged(known if isinstance(known, dict) else {}, value)
            elif value is not None:
                out[key] = value
    return out
