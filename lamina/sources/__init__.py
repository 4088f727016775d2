"""Tables on storage: files, versions, the namespace, ingestion."""
