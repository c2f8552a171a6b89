"""constellate: co-occurrence graph analytics and table/text processing as DataFrame functions."""

__version__ = "0.1.0"
