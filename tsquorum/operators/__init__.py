"""Operators over long-format series, scores and ranks."""
