"""Column expressions: text, JSON, scoring rules. All are Catalyst expressions unless named otherwise."""
