"""modelwatch: PySpark-native auditing and monitoring of classifiers."""
