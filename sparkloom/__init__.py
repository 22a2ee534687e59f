"""sparkloom: a DataFrame-first analytics library for PySpark."""

__version__ = "0.1.0"
