"""Whole jobs made of operators: training, scoring, evaluation, monitoring."""
