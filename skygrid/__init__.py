"""skygrid: regridding of gridded data between coordinate systems, on Spark DataFrames."""

__version__ = "0.1.0"
