"""Whole plans: the dataset builder and the registered queries with their reference SQL."""
