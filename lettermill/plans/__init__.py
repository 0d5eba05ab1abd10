"""Compositions of operators: analyses, experiments, test inputs."""
