"""Text functions on columns: patterns, offsets, decoders and normalisers."""
