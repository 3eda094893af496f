"""Session-memory analytics and training-data jobs on Apache Spark."""
