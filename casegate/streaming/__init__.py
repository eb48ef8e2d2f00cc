"""Structured Streaming forms of classification, state tracking and timeouts."""
