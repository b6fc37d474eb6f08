"""Dataflow and statistical operators over whole tables."""
