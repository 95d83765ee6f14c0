"""Detection of personal, business and credential data and verification of its redaction, on Spark DataFrames."""
