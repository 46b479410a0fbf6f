"""Operators of large-scale training-data pipelines; nothing else in graphloom imports this subpackage."""
