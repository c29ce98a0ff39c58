"""Intermediate tables in the folder that all executors share; see quillon.operators.scratch."""

from quillon.operators.scratch import Scratch, released, shared_folder

__all__ = ["Scratch", "released", "shared_folder"]
