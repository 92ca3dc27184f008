"""Whole runs: training, validation, search and batch scoring."""
