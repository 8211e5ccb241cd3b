"""Privacy and utility analytics for sparse rating data on Spark."""
