"""Operators for preparing language-model training text: each module is one operator over DataFrames."""
