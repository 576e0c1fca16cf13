"""Page-audit and fidelity analytics as Spark jobs."""
