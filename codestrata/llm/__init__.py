"""Training-data operators: one module each, with their registered queries."""
