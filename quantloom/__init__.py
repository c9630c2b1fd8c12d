"""quantloom: a Spark-native engine for scored target/decoy observations and the tables around them."""

__version__ = "0.1.0"
