"""Reasoning-trace analytics on Spark."""
