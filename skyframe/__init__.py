"""Satellite-raster and evidence analytics on Spark DataFrames.

The unit of work is a table of pixels of many scenes, a table of questions or a
table of facts; every operator takes DataFrames and returns DataFrames.
"""
