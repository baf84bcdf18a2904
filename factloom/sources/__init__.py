"""Sources: files, catalogues, pages, configuration."""
