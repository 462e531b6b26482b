"""Ontology query engine on Spark DataFrames."""
