"""lonja: a Spark-first engine for wholesale price and volume series."""
