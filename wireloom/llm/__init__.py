"""Operators for pipelines that prepare training data for language models."""
