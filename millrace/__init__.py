"""millrace: PySpark-native curation, retrieval and evaluation of nested records and documents."""
