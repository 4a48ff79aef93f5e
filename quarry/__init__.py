"""quarry: a PySpark-native engine for SQL workload analytics, plan ranking and corpus preparation."""
