"""Operators for large training-data pipelines; nothing else in vecspark imports this subpackage."""
