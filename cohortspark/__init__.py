"""CT-cohort analytics as Spark DataFrame jobs."""
