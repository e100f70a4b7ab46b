from skein.functions.hashing import bucket, sql_bucket, unit_interval, sql_unit_interval  # noqa: F401
