"""Spark jobs over structural-model data: meshes, results, quantities, contacts, comparison and job logs."""
