"""Spark jobs for passage retrieval: tables of documents and queries in, DataFrames out."""
