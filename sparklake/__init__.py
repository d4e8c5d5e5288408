"""sparklake: a Spark-native engine for event tables."""
