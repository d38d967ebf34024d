"""Column expressions (no UDFs): text, time and label rules."""
