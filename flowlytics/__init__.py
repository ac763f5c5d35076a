"""Product cash-flow analytics as PySpark DataFrame transformations."""
