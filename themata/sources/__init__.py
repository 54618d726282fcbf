"""Readers and writers of corpora, topic-word tables, models and metrics."""
