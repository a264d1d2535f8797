"""Point-cloud, neighbour-graph, voxel and sparse-tensor analytics on Spark DataFrames."""
