"""Column functions: paths, text, classification and scoring."""
