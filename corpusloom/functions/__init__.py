"""Part of corpusloom; see the README."""
