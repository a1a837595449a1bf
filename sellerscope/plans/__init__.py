"""Composed pipelines (profile, seller model, scoring) and the query registry."""
