"""DataFrame to DataFrame operators on sets of objects."""
