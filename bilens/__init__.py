"""bilens: two schemas over one body of data, on Spark.

A mapping between a legacy table and a modern entity is declared once; views,
write-back, proofs, checks, reconciliation, backfill, change feeds and lineage
are all derived from that declaration.
"""
