"""Operators of the submission-log engine."""
