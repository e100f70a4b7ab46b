"""skein: a Spark-native engine for query logs, schema catalogs and dialogue data.

Query logs, catalogs and conversations are DataFrames; every statistic, filter,
sampler and metric over them is a Spark job built from built-in expressions,
windows, joins and aggregates.
"""

__version__ = "0.1.0"
