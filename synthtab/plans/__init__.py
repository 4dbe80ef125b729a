"""Column specs and the multi-step jobs built from the operators."""
