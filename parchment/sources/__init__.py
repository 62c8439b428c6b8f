"""Readers of the driver tables and the adapters to the document model."""
