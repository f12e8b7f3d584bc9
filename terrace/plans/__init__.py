"""Execution helpers shared by the operators: checkpoints, size-checked broadcasts."""
