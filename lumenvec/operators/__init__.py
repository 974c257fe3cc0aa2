"""Search and build operators over triples (doc_id, term, weight)."""
