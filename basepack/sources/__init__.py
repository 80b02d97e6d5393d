"""Readers and writers of FASTA, Zarr v3 groups, chunk files and result tables."""
