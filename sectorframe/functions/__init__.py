"""Expressions on keys, charges, values and histograms."""
