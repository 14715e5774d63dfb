"""Sources of the submission-log engine."""
