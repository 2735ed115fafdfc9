"""Evaluation pairs, vocabulary tables and the result log."""
