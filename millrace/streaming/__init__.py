"""Structured Streaming: the batch transformations on streams (an addition of ours)."""
