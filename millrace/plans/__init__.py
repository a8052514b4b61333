"""Query plans over the tables, by name."""
