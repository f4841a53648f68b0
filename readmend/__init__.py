"""Short-read k-mer analytics and error correction as Spark jobs."""
