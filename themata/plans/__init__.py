"""Whole jobs: training, resuming, evaluating, scoring."""
