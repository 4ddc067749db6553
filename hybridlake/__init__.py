"""hybridlake: hybrid retrieval over financial records and documents as Spark DataFrame jobs."""
