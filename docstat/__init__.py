"""docstat: financial-document analytics as ordinary Spark DataFrame pipelines."""
