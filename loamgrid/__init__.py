"""loamgrid: raster scenes, label maps and their analytics as Spark DataFrames."""
