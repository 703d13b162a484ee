"""Part of sqlsift, a Spark-native engine for PostgreSQL query logs."""
