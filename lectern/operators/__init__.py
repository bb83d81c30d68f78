"""Operators over slides, keyphrases and triples: DataFrame in, DataFrame out."""
