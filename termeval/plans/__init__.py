"""Pipelines, metrics and the evaluation runs that combine them."""
