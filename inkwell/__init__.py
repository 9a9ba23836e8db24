"""inkwell: retail analytics for a chain of bookstores, built on Spark DataFrames.

Layout:
    inkwell.schemas      table schemas and key / reference / check metadata
    inkwell.session      session defaults and the checkpoint folder
    inkwell.sources      table loading, test-data adapter, CSV export, snapshots
    inkwell.functions    column expressions: text matching, parsing, formatting, ordinals
    inkwell.operators    reports, list views, quality checks, posting, upserts
    inkwell.plans        query registry, layout for large tables, plan inspection
    inkwell.streaming    sale posting driven by Structured Streaming micro-batches
"""

__version__ = "0.1.0"
