"""Byte parsers: each turns one document into a Result, without Spark, so that tests and
Arrow-batched operators share them."""
