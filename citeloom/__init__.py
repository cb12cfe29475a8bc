"""citeloom: Spark-native citation analytics over document collections."""
