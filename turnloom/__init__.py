"""turnloom: Spark-native analytics over turn-structured conversation data."""
