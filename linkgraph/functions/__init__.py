"""Scalar and temporal functions of the query language as Spark columns."""
