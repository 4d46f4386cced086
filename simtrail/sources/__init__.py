"""Readers/writers for the job's tables and stand-ins built from the driver tables."""
