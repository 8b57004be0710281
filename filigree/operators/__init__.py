"""Operators on DataFrames of polylines, junctions, pixels, labels and predictions."""
