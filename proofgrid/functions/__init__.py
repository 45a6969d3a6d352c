"""Part of proofgrid."""
