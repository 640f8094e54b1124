"""A PySpark-native engine for contract-award data: validation, star-schema
reduction, publishing, deterministic queries and corpus preparation."""
