"""tracewright: a PySpark-native engine for curating and scoring tool-use trajectories."""
