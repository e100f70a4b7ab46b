"""Operators of a training-data pipeline: one module per operator, queries and SQL oracles in ``queries``."""
