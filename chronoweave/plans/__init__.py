"""Plan helpers shared by operators: lineage cuts, running positions, size-checked broadcasts."""
