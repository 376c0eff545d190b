"""Whole plans: the queries of the driver contract and their SQL twins."""
