"""tramline: transit-spacing analytics and data-cleaning operators on PySpark DataFrames."""
