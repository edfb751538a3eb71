"""Registered queries, each with its equivalent SQL where SQL can express it."""
