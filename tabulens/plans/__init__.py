"""Multi-step compositions of the operators."""
