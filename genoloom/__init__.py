"""A Spark-native engine for genomics tables: variants, intervals, reads and sequences."""
