"""Point-cloud, voxel and mesh analytics expressed as Spark DataFrame jobs."""
