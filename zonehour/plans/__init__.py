"""Flows that chain operators: from events to densities, search, reports."""
