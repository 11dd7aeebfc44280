"""Marketplace analytics on PySpark: listings, comparables, pricing, taxonomies and text operators."""
