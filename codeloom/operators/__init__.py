"""Extraction, resolution, aggregation, graph and report operators."""
