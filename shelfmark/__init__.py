"""Shelfmark: a provider-neutral resource catalog built and queried on Spark."""
