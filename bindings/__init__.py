"""How the registered queries derive the library's input tables from the given parquet tables."""
