"""Post-archive marker-frequency analytics, expressed as Spark DataFrame jobs."""
