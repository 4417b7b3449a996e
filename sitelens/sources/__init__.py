"""Sources and sinks.  Bytes come through Spark's readers, so any file system works."""
