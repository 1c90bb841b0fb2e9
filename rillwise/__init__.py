"""Urban flood-risk analytics as set-based PySpark operators."""
