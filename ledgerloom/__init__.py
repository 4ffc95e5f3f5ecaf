"""Ledger risk analytics on PySpark: features, motifs, graph evidence, windows, metrics and audits."""
