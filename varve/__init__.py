"""varve: a Spark-native engine for series preparation, feature work, profiling and forecasting queries."""
