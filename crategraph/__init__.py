"""crategraph: a PySpark engine for catalogs gathered from many partial, conflicting sources."""
