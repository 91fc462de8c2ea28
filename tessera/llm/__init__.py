"""Operators for building language-model training data.

Nothing else in the package imports this folder.  Every operator takes and returns DataFrames;
`queries` holds the registered queries and `oracles` their SQL where SQL can express them.
"""
