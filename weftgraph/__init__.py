"""A PySpark-native engine that holds a source tree as a property graph and answers questions over it."""
