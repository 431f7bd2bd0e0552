"""Semantic models that build one lazy frame per question."""
