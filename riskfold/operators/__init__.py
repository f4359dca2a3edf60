"""Relational operators: cohorts, folds, curves, thresholds, metrics, models."""
