"""A Spark-native engine for spatio-temporal demand."""
