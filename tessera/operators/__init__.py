"""Operations on arrays held as DataFrames.

A vector is (idx, v); a matrix or tensor has one column per axis and v.  Rows have no order of their own, so
what depends on position takes axis columns.
"""
