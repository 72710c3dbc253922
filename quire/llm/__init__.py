"""Operators of a training-data pipeline: each module holds one operator with a general
DataFrame interface; ``queries`` holds the registered queries and their SQL."""
