"""quarry: a PySpark-native engine for curating source-code and text corpora."""
