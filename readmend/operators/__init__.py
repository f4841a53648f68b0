"""DataFrame-to-DataFrame operators: profiling, counting, filter, repair."""
