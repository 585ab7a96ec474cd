"""A Spark-first library for data made of entities split into labelled regions."""
