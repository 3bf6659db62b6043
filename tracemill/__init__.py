"""Spark operators for training traces, rollouts and probe samples."""
