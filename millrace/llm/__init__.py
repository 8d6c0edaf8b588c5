"""Operators of a training-data pipeline: counting, identification, matching and de-duplication."""
