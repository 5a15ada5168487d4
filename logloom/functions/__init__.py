"""Column-expression functions (all JVM-side built-ins, no UDFs) plus the
small Porter stemmer helper used by the vectorised stemming UDF."""
