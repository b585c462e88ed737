"""Training-data operators. Nothing outside this subpackage imports it, save the query registry."""
