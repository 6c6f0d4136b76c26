"""innkeep: hospitality bookings analytics as Spark DataFrame jobs."""

from .sources.tables import load_tables, read_tables  # noqa: F401

__version__ = "0.1.0"
