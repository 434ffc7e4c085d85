"""wayfold: similarity search over trajectories, and corpus preparation, on Spark."""
