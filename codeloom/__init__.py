"""Source-corpus analytics on Spark: extraction, resolution, scoring, reports."""
