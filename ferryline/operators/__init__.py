"""DataFrame operators: selection, merge, checks, graph, reconciliation."""
