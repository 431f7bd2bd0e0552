"""Scalar and aggregate column expressions."""
