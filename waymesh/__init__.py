"""Road-network fusion and audit as Spark DataFrame jobs."""
