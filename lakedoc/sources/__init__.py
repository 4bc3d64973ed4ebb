"""Readers: files, the Spark catalog, JDBC, manifests, documentation files."""
