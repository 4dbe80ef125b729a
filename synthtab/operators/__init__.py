"""DataFrame operators: generation, injection, profiling and scoring."""
