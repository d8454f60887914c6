"""Column expressions over nested arrays, and distributions in numpy."""
