"""Table sync, conformance and audit operators as Spark DataFrame functions."""
