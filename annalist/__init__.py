"""A Spark-native engine that keeps dated, evidence-linked history of text logs."""
