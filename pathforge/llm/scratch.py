"""Intermediate tables in the folder that the driver and the executors share."""

from ..store import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
