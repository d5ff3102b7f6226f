"""Readers that give transcripts, words, rules and files as DataFrames."""
