"""Facts of source files: definitions, references, imports, string mentions; one extractor for Python, one for brace languages."""
