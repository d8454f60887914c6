"""The genotype relation made from the supplied tables, and queries over it."""
