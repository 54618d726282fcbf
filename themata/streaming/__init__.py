"""Scoring of a corpus that keeps arriving."""
