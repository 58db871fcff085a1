"""tagloom: DataFrame operators for large tagged media catalogs."""
