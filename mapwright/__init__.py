"""mapwright: a Spark-native engine that turns engineering articles into a company-wide system map."""

__version__ = "0.1.0"
