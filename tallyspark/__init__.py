"""A Spark-first engine that turns positioned words into checked ledgers.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (bound queries and
their oracle SQL), ``streaming`` (the incremental forms).
"""
