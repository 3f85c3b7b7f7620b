"""Panel descriptions and the registered queries."""
