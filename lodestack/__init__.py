"""lodestack: array recovery analytics and training-data operators on Spark."""
