"""Transaction-risk analytics written as Spark DataFrame and Structured Streaming jobs."""
