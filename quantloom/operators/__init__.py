"""DataFrame -> DataFrame operators on long tables."""
