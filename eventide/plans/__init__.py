"""What users run: the layered pipeline and the lookups over its tables."""
