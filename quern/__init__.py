"""quern: a PySpark-native engine for evidence-grounded knowledge graphs."""
