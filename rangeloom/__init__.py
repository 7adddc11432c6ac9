"""Sequence-graph range analytics and corpus preparation as Spark jobs."""
