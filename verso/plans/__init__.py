"""End-to-end plans, model backends and the registered queries."""
