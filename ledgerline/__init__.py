"""Governed analytics on Spark: concepts, relationships with declared fan-out, and metrics.

A plan over business concepts is certified for grain and lowered to DataFrames in which every
measured row counts exactly once for each output group, or it is refused.
"""
