"""Parameters and cost formulas from which an evaluation method is chosen."""
