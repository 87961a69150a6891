"""Rule-based security findings over large collections of C/C++ source text, on Spark."""

from .options import ScanOptions

__all__ = ["ScanOptions"]
