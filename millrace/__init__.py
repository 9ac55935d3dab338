"""millrace: a Spark-first engine for building, measuring and curating text corpora."""
