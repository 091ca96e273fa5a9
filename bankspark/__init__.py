"""bankspark: retail-bank data checks, preparation and analyses as Spark DataFrame operators."""

__version__ = "0.1.0"
