"""Parameterised plans: dashboard selections, the end-to-end load, the query catalog."""
