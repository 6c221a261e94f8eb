"""frameweave: animated-image analytics as PySpark DataFrame transforms."""

__version__ = "1.0.0"
