"""Training-data operators: filters, classifiers, deduplication, search, privacy and packing.

Nothing outside this subpackage imports it; the registry at the repository top
adds its queries when it is present.
"""
