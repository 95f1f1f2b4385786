"""gridspark: spreadsheet-style table analytics as Spark DataFrames."""
