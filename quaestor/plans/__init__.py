"""Views over the tables at hand, and the registered queries on them."""
