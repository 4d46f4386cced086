"""Domain operators: pure ``DataFrame -> DataFrame`` functions, lazily composed."""
