"""trigrid: analytics for large sparse feature-by-sample matrices on Spark DataFrames."""

from trigrid.matrixset import MatrixSet

__all__ = ["MatrixSet"]
