"""Errors raised on the driver from shapes and parameters."""


class ArrayError(ValueError):
    pass


class DimensionMismatch(ArrayError):
    pass


class ShapeMismatch(ArrayError):
    pass


class RankMismatch(ArrayError):
    pass


class IndexOutOfBounds(ArrayError):
    pass


class SingularMatrix(ArrayError):
    pass


class MatrixNotPositiveDefinite(ArrayError):
    pass


class InvalidShape(ArrayError):
    pass


class DepthLimit(ArrayError):
    pass


class NoConvergence(ArrayError):
    pass
