"""Row selection, predicates and indexes."""
