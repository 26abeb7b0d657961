"""Operators of a training-data pipeline over tables of documents. Nothing else in the library imports this."""
