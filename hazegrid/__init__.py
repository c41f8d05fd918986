"""Gridded air-quality, hotspot and transport analytics expressed as Spark DataFrames."""

from hazegrid.grid import GridSpec
from hazegrid.session import build_session

__all__ = ["GridSpec", "build_session"]
