"""A Spark-native engine for block-wise reconstruction analytics: see README.md."""
