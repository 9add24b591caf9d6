"""weftline: a PySpark-native analytics engine for intake records, gazetteers and policy corpora."""
