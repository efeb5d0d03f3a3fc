"""seqloom: sequence, interval and annotation analytics as Spark plans."""
