"""Operators for preparing language-model training data with Spark.

Nothing else in the library imports this subpackage.
"""
