"""Inputs and outputs: CSV scans, source routing, statement text, CSV sinks."""
