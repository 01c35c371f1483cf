"""Corpus analytics and hybrid retrieval as plain Spark jobs."""
