"""Document analytics on PySpark: sources, relational operators, rule engines and stream jobs."""
