"""Operators over tables of byte sequences, intervals, edits, layouts and references."""
