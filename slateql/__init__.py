"""slateql: a transactional SQL table engine and corpus operators on PySpark."""

__version__ = "0.1.0"
