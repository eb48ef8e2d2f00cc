"""Whole runs: classify, load, reconcile, and the chain of the three."""
