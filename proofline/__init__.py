"""A Spark-native engine that audits agent session transcripts."""
