"""Column functions: text, matching keys, ids, morphology, languages."""
