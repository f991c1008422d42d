"""End-to-end jobs (index a tree, search) and the registered queries."""
