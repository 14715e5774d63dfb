"""Functions of the submission-log engine."""
