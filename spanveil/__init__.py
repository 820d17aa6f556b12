"""Detection, replacement and restoring of personal data on Spark."""
