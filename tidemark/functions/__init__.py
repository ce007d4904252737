"""Factor formulas as Catalyst columns, and hashes."""
