"""Column functions: JSON fields, identifiers, routing, hashes."""
