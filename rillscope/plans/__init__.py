"""The end-to-end plan."""

from .pipeline import Pipeline, Result, detect

__all__ = ["Pipeline", "Result", "detect"]
