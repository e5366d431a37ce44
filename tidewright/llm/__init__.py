"""Operators that prepare text corpora and embeddings for model training."""
