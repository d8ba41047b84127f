"""Batch operators over transaction, scored and request tables."""
