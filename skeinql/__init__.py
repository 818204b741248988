"""A typed query engine whose definitions compile to Spark DataFrame plans."""
