"""Entity-year panel analytics on Spark: every analysis is a DataFrame -> DataFrame function."""
