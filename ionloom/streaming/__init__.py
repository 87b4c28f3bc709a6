"""Annotation of run files as they arrive."""
