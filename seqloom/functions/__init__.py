"""Column builders: sequence codecs and numeric helpers."""
