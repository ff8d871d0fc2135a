"""Global options."""

from __future__ import annotations

_DEFAULTS = {"align.join": "outer", "op.reindex": True, "op.broadcast": True, "display.max": 100, "indexing.by": "label", "axis.broadcast_labels": 100_000, "scan.block": 10_000, "axis.list_hits": 1_000_000, "reduce.sort_rows": 1_000_000}
_values = dict(_DEFAULTS)


def get_option(name: str):
    return _values[name]


def set_option(name: str, value) -> None:
    if name not in _values:
        raise KeyError(f"no option {name!r}; there are {sorted(_values)}")
    _values[name] = value


def reset_options() -> None:
    _values.update(_DEFAULTS)


def print_options() -> str:
    text = "\n".join(f"{k}: {v!r}" for k, v in sorted(_values.items()))
    print(text)
    return text
