"""notelake: a PySpark-native engine for versioned corpora of text notes."""
