"""netloom: network-sensor log processing on Apache Spark."""
