"""Topics, codecs, schemas and sinks."""
