"""Models are behind protocols: judges, embedders and searchers run in Arrow batches, once for each distinct prompt."""
