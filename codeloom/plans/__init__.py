"""Whole-run plans composed of the operators."""
