"""tarnlake: a Spark-native relational engine over versioned Parquet tables."""
