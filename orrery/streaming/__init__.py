"""Rollups kept fresh from streams."""
