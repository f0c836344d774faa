"""Tables and the canonical views over them."""
