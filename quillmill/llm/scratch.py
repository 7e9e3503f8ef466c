"""Intermediate tables of the operators; see ``quillmill.tables``."""

from ..tables import clear, cut, discard, shared_dir

__all__ = ["clear", "cut", "discard", "shared_dir"]
