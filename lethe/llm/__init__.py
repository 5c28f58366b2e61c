"""Operators for building training data: one module an operator, DataFrame in and DataFrame out."""
