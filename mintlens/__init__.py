"""Card-condition analytics on Spark."""
