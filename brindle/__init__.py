"""brindle: a Spark-native engine for versioned, branch-aware code graphs and for preparing training data."""
