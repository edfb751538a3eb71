"""Relational and dataflow operators: pure DataFrame -> DataFrame functions."""
