"""A Spark-native engine for receipt documents: repair, field extraction, categories, evaluation."""
