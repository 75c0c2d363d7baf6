"""Ranks within groups of any size, from the core."""

from larkline.operators.ranks import SALTS, rank_within

__all__ = ["SALTS", "rank_within"]
