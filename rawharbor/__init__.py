"""Raw-data ingestion, resolution, profiling and publication on Spark."""
