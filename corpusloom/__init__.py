"""Corpusloom: building, auditing and statistically evaluating labelled corpora on Spark."""
