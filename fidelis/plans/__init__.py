"""Composed plans: the validation layers, scoring/decision, reports, and the query catalog."""
