"""Every query next to an independent SQL statement of the same result.

The SQL is written the plain way (range joins, self joins, one pass per run date); the
Spark side is not. Agreement between the two is therefore evidence.
"""
