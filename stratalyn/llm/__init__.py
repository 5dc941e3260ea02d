"""Training-data operators: everything a corpus pipeline needs, nothing the analytics engine imports."""
