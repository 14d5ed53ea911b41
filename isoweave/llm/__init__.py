"""Operators of a training-text pipeline."""
