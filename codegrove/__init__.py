"""codegrove: terminology analytics on PySpark."""
