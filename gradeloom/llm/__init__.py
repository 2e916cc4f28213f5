"""Operators of a training-data pipeline: each works on whole tables of documents or pages."""
