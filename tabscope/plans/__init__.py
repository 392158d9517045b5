"""Shared passes over the data: kinds, moments, quantiles, value counts and pair moments."""
