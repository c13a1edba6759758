"""Strain-level metagenomics analytics on PySpark."""
