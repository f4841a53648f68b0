"""FASTQ source and sink, read lists, and reads derived from text tables."""
