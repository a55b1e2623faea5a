"""Typed readers, JSON-reply flatteners, sinks and the testdata adapters."""
