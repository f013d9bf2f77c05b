"""Complete analyses: the registered star-schema queries and the fifteen panel questions."""
