"""texspark: block-compressed texture processing on PySpark."""

__version__ = "0.1.0"
