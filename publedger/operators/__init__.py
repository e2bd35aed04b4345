"""DataFrame operators, one module per subject area.

Shared habits: groups are shrunk by partial aggregation before any shuffle, top-k per group
is a ``row_number`` filter (which Spark turns into a per-task limit before the shuffle), and
small sides are left to Spark's own size check instead of being forced to broadcast.
"""
