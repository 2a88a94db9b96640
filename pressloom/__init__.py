"""pressloom: collect, clean, deduplicate, rank and digest news items on Spark.

Every operator is a function from DataFrames (plus an explicit ``as_of``) to a
DataFrame. Nothing reads the clock and nothing holds a session.
"""
