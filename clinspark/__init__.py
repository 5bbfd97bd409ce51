"""Clinical-document and imaging-index jobs expressed as Spark DataFrame transformations."""

__version__ = "0.1.0"
