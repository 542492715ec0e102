"""Registered queries: operators applied to the canonical views, each with its SQL."""
