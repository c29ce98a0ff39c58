"""Connected components; see quillon.operators.graph."""

from quillon.operators.graph import components

__all__ = ["components"]
