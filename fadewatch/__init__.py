"""fadewatch: early-life degradation analytics over entity x cycle x point tables.

Every operator takes DataFrames and returns DataFrames, written with Spark SQL
expressions, windows and MLlib.
"""
