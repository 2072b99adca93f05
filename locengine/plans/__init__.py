"""Whole flows, the registered queries and their SQL counterparts."""
