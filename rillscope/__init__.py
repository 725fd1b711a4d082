"""Congestion analysis of network latency series on Spark."""

from __future__ import annotations

__version__ = "0.2.0"

#: Public names and the modules that have them; each is imported when it is first used.
_EXPORTS = {
    "Config": "config", "load_config": "config", "Pipeline": "plans.pipeline", "Result": "plans.pipeline", "register_detector": "plans.pipeline", "detect": "plans.pipeline",
    "get_session": "session", "read_path": "sources", "read_csv": "sources", "read_scamper": "sources", "normalize": "sources", "save": "sinks", "register_functions": "functions.table",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    import importlib

    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
