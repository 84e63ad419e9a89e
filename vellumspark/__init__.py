"""A Spark-first engine for verifying, cataloguing and searching text collections."""
