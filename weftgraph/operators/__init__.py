"""Operators over build graphs and logs."""
