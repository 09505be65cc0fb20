"""Corpus analytics for PySpark: curate, split, sample and evaluate text and code."""

__version__ = "0.1.0"
