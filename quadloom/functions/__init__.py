"""Scalar functions of query expressions and of document extraction."""
