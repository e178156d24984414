"""Clinical-document analytics on Spark: reads, access decisions, mutations, pipelines and streams."""
