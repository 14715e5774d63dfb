"""Plans of the submission-log engine."""
