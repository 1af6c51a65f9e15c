"""Operators on DataFrames: intervals, splits, scanning, motifs, ranking, regression and more."""
