"""Readers with fixed schemas, writers with manifests, idempotent tables."""
