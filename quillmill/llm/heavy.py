"""Joins with frequent keys; see ``quillmill.heavy``."""

from ..heavy import join_unique

__all__ = ["join_unique"]
