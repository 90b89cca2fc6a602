"""Column functions: text, entities, alignment, scores, statistics."""
