"""Relation-level operators: ``DataFrame -> DataFrame`` functions."""
