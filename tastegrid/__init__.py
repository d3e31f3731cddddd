"""Catalogs and taste profiles on Spark: DataFrame operators, sources and streaming jobs."""
