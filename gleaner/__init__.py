"""gleaner: a PySpark-native engine for graph crawling analytics and tables."""
