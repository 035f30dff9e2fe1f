"""Column functions: text, numbers, time and redaction."""
