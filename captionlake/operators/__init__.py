"""Operators over transcripts: DataFrame in, DataFrame out."""
