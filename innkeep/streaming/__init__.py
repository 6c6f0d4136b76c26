"""Streaming wrappers: the batch change jobs driven by Structured Streaming."""
