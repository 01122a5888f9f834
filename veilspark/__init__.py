"""Detection and redaction of personal data over tables of text, on Spark."""
