"""Sequence analytics on Spark: counting, context models, hidden Markov models, motifs, search."""
