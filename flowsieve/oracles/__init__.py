"""DuckDB SQL text that states each query independently (the correctness oracle).

The SQL is written as brute force (pair joins, plain GROUP BY) so that it checks
the Spark plans by a different route. It runs on the driver tables as views.
"""
