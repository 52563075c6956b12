"""Operators of a training-data pipeline: packing, media columns, mixing, token
counts and stores, personal data, toxicity, URL rules, nearest neighbours and
near duplicates.  Nothing else in the library imports this subpackage.
"""
