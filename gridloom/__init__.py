"""gridloom: workbook calculation and document extraction on Spark DataFrames."""

__version__ = "0.1.0"
