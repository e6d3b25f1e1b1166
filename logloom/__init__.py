"""Cloud access-log analytics as PySpark DataFrame operators."""
