"""Operators for training data of language models and of models of spectra; nothing outside imports this package."""
