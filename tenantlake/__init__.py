"""Spark-native supplier-data lakehouse: delivered data to bronze, silver and gold."""
