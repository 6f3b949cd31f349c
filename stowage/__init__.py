"""Analytics for content-addressed object stores, and for training data, on Spark."""
