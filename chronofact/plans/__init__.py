"""Domain views and the registered queries over them."""
