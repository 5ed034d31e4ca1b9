"""Relational operators over documents: DataFrame in, DataFrame out."""
