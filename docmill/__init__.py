"""docmill: document analytics as PySpark DataFrame transformations."""

__version__ = "0.2.0"
