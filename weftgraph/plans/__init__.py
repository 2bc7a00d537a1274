"""Whole graphs and what is planned over them."""

from .graph import BuildGraph

__all__ = ["BuildGraph"]
