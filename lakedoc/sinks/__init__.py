"""Writers for catalogs, documents, documentation and comments."""
