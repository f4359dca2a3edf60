"""Whole runs: nested evaluation, fusion, scoring, evaluation tables."""
