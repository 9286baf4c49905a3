"""tessera: document listing and sequence classification as Spark DataFrame plans."""

__version__ = "0.1.0"
