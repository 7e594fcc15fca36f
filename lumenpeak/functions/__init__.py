"""Fixed values and column helpers shared by every operator."""
