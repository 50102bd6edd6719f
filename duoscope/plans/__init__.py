"""Adapters over the benchmark tables and the catalog of registered queries."""
