"""Relational, graph, vector and learner operators, as functions of DataFrames."""
