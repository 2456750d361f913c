"""A Spark-native engine that builds, searches and maintains a knowledge base."""
