"""Semantic typing of text spans and table columns as Spark jobs."""
