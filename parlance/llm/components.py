"""Connected components by alternating large-star and small-star joins: the core's, under the name the operators here use."""

from parlance.operators.graph import connected_components

__all__ = ["connected_components"]
