"""Multi-channel recordings, weighted graphs, voxel tables and complex spectra as Spark DataFrames."""
