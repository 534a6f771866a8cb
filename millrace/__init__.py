"""millrace: language-model training data as Spark DataFrame jobs."""
