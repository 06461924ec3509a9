"""Column functions: identifiers, redaction, type families."""
