"""Lending-gap analytics on Spark: lazy DataFrame functions over program extracts."""
