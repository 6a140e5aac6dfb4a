"""A Spark-native engine for document analytics: operators as DataFrame plans."""
