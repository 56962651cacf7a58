"""Run-audit analytics expressed as Spark DataFrame jobs."""
