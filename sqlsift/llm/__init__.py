"""Operators for large training-data pipelines; nothing else in sqlsift imports this subpackage."""
