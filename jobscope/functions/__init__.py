"""Column functions: scheduler text, job identity, sequencing helpers."""
