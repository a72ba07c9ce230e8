"""Operators on cells, weights and histograms."""
