"""Tables and connectors."""
