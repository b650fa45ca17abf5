"""Readers for waveform, annotation, beat and manifest files."""
