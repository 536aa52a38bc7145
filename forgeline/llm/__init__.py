"""Training-data operators: one module for each, with the thin queries in ``queries.py``."""
