"""quarry: a Spark-native search and data-processing engine for text collections."""
