"""Hand-made bookings tables with the declared (string id) schema."""

from innkeep.sources.schema import SPECS


def make_tables(spark, **rows):
    """One DataFrame per bookings table; tables not given are empty."""
    return {name: spark.createDataFrame(rows.get(name, []), spec.struct()) for name, spec in SPECS.items()}
