"""Whole pipelines, and help with how plans are staged and joined."""
