"""Spark jobs over sampled scalar fields, meshes and graphs, and over training-text corpora."""
