"""SQL counterparts of the registered queries, written apart from them."""
