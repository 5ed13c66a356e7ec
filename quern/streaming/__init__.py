"""Stateful streaming forms of the sequential operators."""
