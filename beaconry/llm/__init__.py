"""Operators for training-data corpora: near duplicates, classifiers, archives, packing, formatting and mixing."""
