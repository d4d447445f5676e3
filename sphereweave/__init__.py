"""Remapping of scalar fields between point sets on the sphere, as Spark DataFrame plans."""
