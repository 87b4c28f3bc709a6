"""Spectral matching and lipid annotation as Spark jobs."""

from ionloom.session import checkpoint_dir, get_session, tune

__all__ = ["checkpoint_dir", "get_session", "tune"]
