"""Configuration: typed defaults, deep merge, warnings (SET08, PRD24). Driver-side: it is small."""

from __future__ import annotations

from typing import Any

#: Defaults of the thresholds that operators take as parameters.
DEFAULTS: dict[str, Any] = {
    "coupling": {"bulk": 50, "support": 3, "ratio": 0.30},
    "ranking": {"top": 25, "spread": 0.5},
    "hotspots": {"fraction": 0.1, "least": 5, "most": 50},
    "suppress": [],
}


def merged(base: Any, over: Any) -> Any:
    """Maps merge key by key, anything else is replaced; neither input is changed."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


def checked(config: dict[str, Any], defaults: dict[str, Any] | None = None, at: str = "") -> tuple[dict[str, Any], list[str]]:
    """The configuration over its defaults, and a warning for each unknown key or value of the wrong type, which keeps its default."""
    defaults = DEFAULTS if defaults is None else defaults
    out, warnings = dict(defaults), []
    for k, v in config.items():
        name = f"{at}{k}"
        if k not in defaults:
            warnings.append(f"unknown key {name}")
        elif isinstance(defaults[k], dict) and isinstance(v, dict):
            out[k], more = checked(v, defaults[k], name + ".")
            warnings += more
        elif isinstance(v, bool) != isinstance(defaults[k], bool) or not isinstance(v, type(defaults[k])) and not (isinstance(defaults[k], float) and isinstance(v, int)):
            warnings.append(f"{name} should be {type(defaults[k]).__name__}")
        else:
            out[k] = v
    return out, warnings
