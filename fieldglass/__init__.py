"""Area, evidence and organisation analytics as Spark DataFrame jobs."""
