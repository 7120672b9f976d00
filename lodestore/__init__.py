"""Vector collections and training-data operators on Spark."""
