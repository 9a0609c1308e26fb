"""gridloom: DataFrame operators for multi-sensor raster time series on Spark."""
