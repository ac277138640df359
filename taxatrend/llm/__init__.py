"""Operators of a training-data pipeline, each over DataFrames: text, documents, vectors, pages, conversations."""
