"""Corpus preparation for language-model training: ten operators on DataFrames of documents."""
