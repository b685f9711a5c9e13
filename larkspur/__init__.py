"""Larkspur: one SQL surface over documents, graphs, shapes, vectors and text, on Spark DataFrames."""
