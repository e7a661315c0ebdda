"""Operators: free functions from DataFrame to DataFrame, usable through DataFrame.transform."""
