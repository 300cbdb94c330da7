"""helixframe: a PySpark-native engine for sequencing-shaped data (reads, variants, intervals, counts, sequence)."""
