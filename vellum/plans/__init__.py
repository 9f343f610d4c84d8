"""Declarative requests, validated and planned as DataFrames."""
