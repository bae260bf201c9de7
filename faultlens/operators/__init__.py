"""Operators: DataFrame -> DataFrame functions, composable with ``DataFrame.transform``."""
