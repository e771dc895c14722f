"""Provenance-graph analytics on Spark: plain ``DataFrame -> DataFrame`` functions."""
