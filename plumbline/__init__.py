"""plumbline: a Spark-native engine that measures inventory evidence against known plants."""
