"""Proof-carrying graph analytics and training-data operators on Spark."""
