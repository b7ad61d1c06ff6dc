"""Densities of a per-event measure for every zone and hour of the week, on Spark.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (whole flows
and reports).
"""
